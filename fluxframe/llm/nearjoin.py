"""Jaccard join of word shingles by parity sketches.

A document's set of shingle hashes is dealt over the segments of a sketch, and
each segment holds the XOR of its shingles: its parity. A shingle that only one
of two sets has changes one segment, so two sets with a symmetric difference of
d differ in d segments at most. For a similarity of 0.8, d is at most a ninth of
the two sizes' sum; segments are counted per size band so that more than d of
them are filled. Two linked sets then share a segment among the d + 1 rarest of
each (pigeonhole), and only those meet in a join. What meets is compared by a
bit sketch, whose Hamming distance bounds d from below, then by the sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxframe.llm.graph import components
from fluxframe.llm.text import batches, combine, mix, released, staged, word_hashes, worker_state

WIDTH = 5  # words in a shingle
#: Linked: PARTS * intersection >= SHARE * union.
SHARE, PARTS = 80, 100
SKETCH_BITS = 512  # at least; a sketch has more bits than its set has members
#: Documents drawn to find segments that a large share of all documents has. It decides where rows are dealt to, never a result.
SAMPLE = 4_000
#: A segment value in so many of the drawn sets is dealt over all partitions.
OFTEN = 24
#: Sets far from a group's leader that are compared with all of the group; with more of them, differences from the leader are joined. Never decides a result.
FEW = 1
#: Sets that one task remembers to send repeated ones once.
REMEMBER = 50_000
#: Parts in which segments are exchanged, one after the other: the documents are hashed once for each, and only one part's shuffle files exist at a time.
PASSES = 2
#: Bytes of text that a task hashes at a time.
SLICE = 1 << 20
#: Segments that a task packs into rows at a time.
PACK = 1 << 19
#: Bytes of text whose segments meet in one partition, in PASSES turns: about a million segments a turn.
MEETING = 16 << 20
#: What a segment that is dealt over all partitions counts for: more sets than any other one has.
MANY = 1 << 40


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; with fewer words than WIDTH, of the whole sequence; empty without words."""
    h, at = word_hashes(texts)
    wide = combine([h[i : len(h) - WIDTH + 1 + i] for i in range(WIDTH)]) if len(h) >= WIDTH else h[:0]
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= WIDTH:
            yield np.unique(wide[a : b - WIDTH + 1])
        elif b > a:
            short = np.array([b - a], dtype=np.uint64)
            for w in h[a:b]:
                short = combine([short, np.array([w])])
            yield short
        else:
            yield h[:0]


def band_of(n: int) -> int:
    """Sizes 1, 2-3, 4-7, 8-15, ..."""
    return int(n).bit_length() - 1


def segments_in(band: int) -> int:
    """More segments than a linked pair whose smaller set lies in the band can differ in, with room for empty ones."""
    return max(64, (5 << band) // 8 + 16)


def segment_keys(s: np.ndarray, band: int) -> np.ndarray:
    """Keys of the filled segments: the parity of their shingles, mixed with the band and the segment's number."""
    m = segments_in(band)
    number = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)  # sorted, as s is
    starts = np.flatnonzero(np.diff(number, prepend=np.uint64(m)))
    parity = np.bitwise_xor.reduceat(mix(s), starts)
    return mix(parity + mix(number[starts] * np.uint64(64) + np.uint64(band + 1)))


def bit_sketch(s: np.ndarray) -> np.ndarray:
    """One bit flipped per shingle: bits of two sketches differ in no more places than the sets do in members.

    The length is a power of two; the XOR of a sketch's halves is the sketch of half the length.
    """
    length = max(SKETCH_BITS, 2 << band_of(len(s)))
    bits = np.bincount((mix(s) & np.uint64(length - 1)).astype(np.int64), minlength=length) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _identity(s: np.ndarray) -> int:
    """64 bits that name a set, made of its members and its size. Like the shingles' own hashes they are taken as exact; of a billion different sets any two share a name with odds of 3 %."""
    parity = np.bitwise_xor.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D)), keepdims=True)
    return int(combine([parity, np.array([len(s)], dtype=np.uint64)])[0].view(np.int64))


def _bands(n: int) -> list[int]:
    """The set's own band, and the one below for smaller partners in it."""
    k = band_of(n)
    return [k, k - 1] if k and PARTS * ((1 << k) - 1) >= SHARE * n else [k]


def segment_names(s: np.ndarray, band: int, places: int) -> np.ndarray:
    """Sorted distinct names of the filled segments: the place, of ``places``, where a key's sets meet, then 31 bits of the key and the band's last bit.

    Keys that share a name merge in all sets alike, so two sets' names differ in no more places than their keys do.
    """

    def named(keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(32)) % np.uint64(places) << np.uint64(32) | keys & np.uint64(0xFFFFFFFE) | np.uint64(band & 1)

    names = np.unique(named(segment_keys(s, band)))
    if len(names) <= int(_most_apart(len(s), band)):
        # Too few filled segments for the pigeonhole; such sets meet each other under a name of their band.
        names = np.union1d(names, named(mix(np.array([band], dtype=np.uint64))))
    return names


ROWS = "kind int, place int, node bigint, n int, filled int, below int, doc_id bigint, sketch array<bigint>, names binary, nodes binary"


def _blocks(kind: int, place: np.ndarray, names: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
    """One row per place, which ascends, with its names and their sets' nodes side by side."""
    starts = np.flatnonzero(np.diff(place, prepend=-1))

    def binary(values: np.ndarray) -> pa.Array:
        ends = (np.append(starts, len(place)) * values.itemsize).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])

    none = [pa.nulls(len(starts), t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))]
    columns = [pa.array(np.full(len(starts), kind, dtype=np.int32)), pa.array(place[starts].astype(np.int32)), *none, binary(names), binary(nodes)]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in ROWS.split(", ")])


def _rows(docs: DataFrame, heavy: np.ndarray, turn: int = 0, turns: int = 1, places: int = 64) -> DataFrame:
    """Rows of kind 0 for documents (node 0: no words), and the filled segments of their sets, once per task and set, packed by the place where they meet.

    A row of kind 1 holds names without the place, which it has beside them; one
    of kind 2 whole names that are in ``heavy``, which the sets' nodes deal over
    all places. Of ``turns`` calls each gives the segments of its own places, and
    the first one the documents. Documents have how many segments their set
    fills in its own band and in the one below, but for copies within a task.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(None)
        known: set[tuple[int, int]] = set()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

        def packed() -> Iterator[pa.RecordBatch]:
            names, nodes, place, often = (np.concatenate(c) for c in zip(*held))
            held.clear()
            for kind in (1, 2):
                at = np.flatnonzero(often == (kind == 2))
                if len(at):
                    at = at[np.argsort(names[at] if kind == 1 else place[at], kind="stable")]
                    yield _blocks(kind, place[at], names[at].astype(np.uint32 if kind == 1 else np.uint64), nodes[at])

        for b in batches(source, most=SLICE):
            d, out = b.num_rows, []
            nodes, sizes = np.zeros(d, dtype=np.int64), np.zeros(d, dtype=np.int32)
            sketches, filled = [None] * d, [[None] * d, [None] * d]
            for i, s in enumerate(shingle_sets(b.column("text").to_pylist())):
                if not len(s):
                    continue
                nodes[i], sizes[i] = _identity(s), len(s)
                if not turn:
                    sketches[i] = bit_sketch(s)
                if (nodes[i], sizes[i]) in known:
                    continue
                if len(known) >= REMEMBER:
                    known.clear()
                known.add((nodes[i], sizes[i]))
                for j, band in enumerate(_bands(len(s))):
                    out.append((nodes[i], segment_names(s, band, places)))
                    filled[j][i] = len(out[-1][1])
            if out:
                names = np.concatenate([k for _, k in out])
                node = np.repeat(np.array([i for i, _ in out], dtype=np.int64), [len(k) for _, k in out])
                place, often = (names >> np.uint64(32)).astype(np.int64), np.zeros(len(names), dtype=bool)
                if len(heavy):
                    often = heavy[np.minimum(np.searchsorted(heavy, names), len(heavy) - 1)] == names
                    place[often] = (mix(node[often].view(np.uint64)) % np.uint64(places)).astype(np.int64)
                mine = place % turns == turn
                held.append((names[mine], node[mine], place[mine], often[mine]))
            if sum(len(h[0]) for h in held) >= PACK:
                yield from packed()
            if not turn:
                spread = mix(np.arange(d, dtype=np.uint64) + nodes.view(np.uint64)) % np.uint64(places)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.zeros(d, dtype=np.int32)), pa.array(spread.astype(np.int32)), pa.array(nodes), pa.array(sizes),
                    *(pa.array(f, pa.int32()) for f in filled), b.column("doc_id").cast(pa.int64()), pa.array(sketches, pa.list_(pa.int64())),
                    pa.nulls(d, pa.binary()), pa.nulls(d, pa.binary()),
                ], [c.split()[0] for c in ROWS.split(", ")])
        if held:
            yield from packed()
        known.clear()
        released()

    return docs.mapInArrow(run, ROWS)


MET = "kind int, key bigint, node bigint, sets bigint, n int, filled int, below int, doc_id bigint, sketch array<bigint>"


def shared_names(names: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of names and nodes, and how many nodes have the name; names of one node are left out."""
    order = np.argsort(names)
    names, nodes = names[order], nodes[order]
    again = names[1:] == names[:-1]
    more = np.append(again, False) | np.insert(again, 0, False)  # most names have one node, so they go before the finer order
    names, nodes = names[more], nodes[more]
    order = np.lexsort((nodes, names))
    names, nodes = names[order], nodes[order]
    first = np.append(True, (names[1:] != names[:-1]) | (nodes[1:] != nodes[:-1]))[: len(names)]
    names, nodes = names[first], nodes[first]
    times = np.diff(np.flatnonzero(np.append(np.diff(names, prepend=~names[:1]) != 0, True)))
    sets = np.repeat(times, times)
    return names[sets > 1], nodes[sets > 1], sets[sets > 1]


def _met(rows: DataFrame, tasks: int, turns: int = 1) -> DataFrame:
    """Documents of ``rows`` as they are, and a row (kind 1, key, node, sets) for each set and segment of it that others have too, or may have if it is dealt over all places.

    A partition holds the names of its places, as many as MEETING bytes of text have.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(None)
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {1: [], 2: []}
        for b in source:
            kind, place = b.column("kind").to_numpy(), b.column("place").to_numpy()
            for i in np.flatnonzero(kind):
                names, nodes = (np.frombuffer(b.column(c)[i].as_buffer(), dtype=t) for c, t in (("names", np.uint32 if kind[i] == 1 else np.uint64), ("nodes", np.int64)))
                found[kind[i]].append((names | np.uint64(place[i]) << np.uint64(32) if kind[i] == 1 else names.copy(), nodes.copy()))
            docs = b.filter(pa.array(kind == 0))
            if docs.num_rows:
                none = pa.nulls(docs.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [docs.column("kind"), none, docs.column("node"), none, *(docs.column(c) for c in ("n", "filled", "below", "doc_id", "sketch"))], [c.split()[0] for c in MET.split(", ")])
        for kind, blocks in found.items():
            if not blocks:
                continue
            names, nodes = (np.concatenate(c) for c in zip(*blocks))
            blocks.clear()
            if kind == 1:
                names, nodes, sets = shared_names(names, nodes)
            else:
                order = np.lexsort((nodes, names))
                names, nodes = names[order], nodes[order]
                first = np.append(True, (names[1:] != names[:-1]) | (nodes[1:] != nodes[:-1]))
                names, nodes, sets = names[first], nodes[first], np.full(int(first.sum()), MANY)
            for at in range(0, len(names), 1 << 16):
                part = slice(at, at + (1 << 16))
                k = len(names[part])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.ones(k, dtype=np.int32)), pa.array(names[part].view(np.int64)), pa.array(nodes[part]), pa.array(sets[part].astype(np.int64)),
                    *(pa.nulls(k, pa.int32()) for _ in range(3)), pa.nulls(k, pa.int64()), pa.nulls(k, pa.list_(pa.int64())),
                ], [c.split()[0] for c in MET.split(", ")])
        released()

    return rows.repartitionById(tasks, F.expr(f"place div {turns}").cast("int")).mapInArrow(run, MET)


def _most_apart(n, band=None):
    """Largest symmetric difference of a set of ``n`` with a linked one; numbers or Columns.

    Sets meet in the band of the smaller one: in a band below its own, a set's partner ends with that band.
    """
    floor = F.floor if isinstance(n, Column) else np.floor
    most = floor(n * (PARTS / SHARE) + 1e-9)
    if isinstance(n, Column) and band is not None:
        end = F.pow(F.lit(2.0), band + 1)
        most = F.when(n < end, most).otherwise(end - 1)
    elif band is not None:
        most = most if n < 2 << band else (2 << band) - 1
    return floor((n + most) * ((PARTS - SHARE) / (PARTS + SHARE)) + 1e-9)


def _heavy_names(docs: DataFrame, sample: int, total: int, places: int) -> np.ndarray:
    """Names of segments that many of about ``sample`` drawn documents share: bounded, as a drawn set has few segments."""
    drawn = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) < F.lit(int(min(1.0, sample / max(1, total)) * (1 << 30))))
    met = _met(_rows(drawn, np.zeros(0, dtype=np.uint64), places=places), docs.sparkSession.sparkContext.defaultParallelism)
    return np.sort(met.filter((F.col("kind") == 1) & (F.col("sets") >= OFTEN)).select("key").distinct().toArrow()["key"].to_numpy().view(np.uint64))


#: Slots that ids are hashed to before a join; a broadcast table of them has so many rows at most.
SLOTS = 1 << 20


def _sets(docs: DataFrame, carriers: DataFrame) -> DataFrame:
    """(node, n, members) of the nodes in ``carriers`` (node, doc_id), hashed anew from the texts of those documents alone.

    The table of occupied slots is bounded, so it is broadcast and keeps most
    other texts out of the exact join behind it.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[tuple[int | None, int]] = set()  # with the id: the same set under another id may not be its node's carrier
        for b in batches(source, most=SLICE):
            sets = [(i, _identity(s), s) for i, s in zip(b.column("doc_id").to_pylist(), shingle_sets(b.column("text").to_pylist())) if len(s)]
            sets = [x for x in sets if x[:2] not in known and not known.add(x[:2])]
            if len(known) > REMEMBER:
                known.clear()
            yield pa.RecordBatch.from_arrays([
                pa.array([i for i, *_ in sets], pa.int64()), pa.array([node for _, node, _ in sets], pa.int64()), pa.array([len(s) for *_, s in sets], pa.int32()),
                pa.array([s.view(np.int64) for *_, s in sets], pa.list_(pa.int64())),
            ], ["carrier", "node", "n", "members"])
        known.clear()
        released()

    slot = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)).alias("slot")
    ids = carriers.select("doc_id").distinct()
    near = docs.withColumn("slot", slot).join(F.broadcast(ids.select(slot).distinct()), "slot", "left_semi")
    fetched = near.join(ids, near["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi").select("doc_id", "text")
    hashed = fetched.mapInArrow(run, "carrier bigint, node bigint, n int, members array<bigint>")
    mine = (hashed["node"] == carriers["node"]) & hashed["carrier"].eqNullSafe(carriers["doc_id"])
    return staged(hashed.join(carriers, mine, "left_semi").select("node", "n", "members"))  # repeated rows may come twice, which adds no link


def _size_fits(a: str, b: str) -> Column:
    return (F.least(F.col(a), F.col(b)).cast("bigint") * PARTS) >= (F.greatest(F.col(a), F.col(b)).cast("bigint") * SHARE)


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) that link: first by bit sketches, then by the sets of those that are left."""

    def side(table: DataFrame, name: str, what: str) -> DataFrame:
        return table.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col(what).alias(f"{what}_{name}"))

    def folded(p: str, q: str) -> str:  # linked sets lie in the same or the next band, so one fold makes lengths equal
        half = f"CAST(size({p}) div 2 AS int)"
        return f"CASE WHEN size({p}) > size({q}) THEN zip_with(slice({p}, 1, {half}), slice({p}, {half} + 1, {half}), (x, y) -> x ^ y) ELSE {p} END"

    apart = f"aggregate(zip_with({folded('sketch_a', 'sketch_b')}, {folded('sketch_b', 'sketch_a')}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
    near = staged(pairs.join(side(nodes, "b", "sketch"), "b").join(side(nodes, "a", "sketch"), "a").filter(
        F.expr(f"{PARTS + SHARE} * cast({apart} as bigint) <= {PARTS - SHARE} * (cast(n_a as bigint) + n_b)")).select("a", "b"))
    ends = near.select(F.col("a").alias("node")).union(near.select("b")).distinct()
    sets = _sets(docs, nodes.join(ends, "node", "left_semi").select("node", "doc_id"))
    met = near.join(side(sets, "b", "members"), "b").join(side(sets, "a", "members"), "a").withColumn("common", F.size(F.array_intersect("members_a", "members_b")).cast("bigint"))
    return staged(met.filter(F.col("common") * PARTS >= (F.col("n_a") + F.col("n_b") - F.col("common")) * SHARE).select("a", "b"))


def _ends(sets: DataFrame, name: str, *keys: str) -> DataFrame:
    """``sets`` as one end of pairs: its columns but ``keys`` get the end's name."""
    return sets.select(*keys, F.col("node").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in sets.columns if c not in (*keys, "node")])


def _apart() -> Column:
    """Pairs of a far set and another one that no earlier step has joined, each once, of sizes that can link."""
    return (F.col("component_a") != F.col("component_b")) & (~F.col("far_b") | (F.col("a") < F.col("b"))) & _size_fits("n_a", "n_b")


def _by_differences(members: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of ``members`` (lead, n_lead, node, n, component, far) with the same lead; a is far.

    What two sets share with their leader cancels: x and y differ where their
    differences from it, X and Y, do. Were a far x linked with a y and X, Y
    disjoint, x would differ from the leader in no more than a ninth of the sizes'
    sum, that is, be linked with it; so X and Y share members, (|X| + |Y| - d) / 2
    at least. Prefixes of d + 1 members, rarest first, then share one, and behind
    the first shared one enough must be left on both sides. Members that only one
    set of the group has come first and need no row. Edits are rare where the text
    that makes the group large is common to all of it. Groups that share a name of
    their holders by chance only add candidates.
    """
    named = members.select("node").union(members.select(F.col("lead").alias("node"))).distinct()
    sets = _sets(docs, nodes.join(named, "node", "left_semi").select("node", "doc_id")).select("node", "members").dropDuplicates(["node"])
    leads = sets.select(F.col("node").alias("lead"), F.col("members").alias("of_lead"))
    differs = staged(members.join(sets, "node").join(leads, "lead").select(
        "lead", "node", "n", "component", "far", F.concat(F.array_except("members", "of_lead"), F.array_except("of_lead", "members")).alias("difference")))
    often = differs.select("lead", F.explode("difference").alias("e"), "node").groupBy("lead", "e").agg(F.count(F.lit(1)).alias("times"), F.bit_xor(F.xxhash64("node")).alias("holders"))
    each = differs.select("lead", "node", "n", "component", "far", F.size("difference").alias("size"), F.explode("difference").alias("e")).join(often.filter("times > 1"), ["lead", "e"])
    # Members that the same sets have, as the leader's own ones, stand together in the order and are one row with a weight.
    each = each.groupBy("lead", "node", "n", "component", "far", "size", "times", "holders").agg(F.count(F.lit(1)).alias("weight"))
    own = Window.partitionBy("lead", "node")
    before = F.coalesce(F.sum("weight").over(own.orderBy("times", "holders").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = F.col("size") - F.sum("weight").over(own) + before
    prefix = staged(each.withColumn("at", at).filter(F.col("at") <= _most_apart(F.col("n"))).drop("weight"))
    apart = F.floor((F.col("n_a") + F.col("n_b")) * (PARTS - SHARE) / (PARTS + SHARE) + 1e-9)
    enough = 2 * F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b")) >= F.col("size_a") + F.col("size_b") - apart
    met = _ends(prefix.filter("far"), "a", "lead", "times", "holders").join(_ends(prefix, "b", "lead", "times", "holders"), ["lead", "times", "holders"])
    return met.filter(_apart() & enough).select("a", "b").distinct()


def _stars(grouped: DataFrame) -> DataFrame:
    """Pairs (a, b) of each row's head and the row's set where their sizes can link."""
    pairs = grouped.select(F.col("head.node").alias("a"), F.col("node").alias("b"), F.col("head.n").alias("n_a"), F.col("n").alias("n_b"))
    return pairs.filter((F.col("a") != F.col("b")) & _size_fits("n_a", "n_b")).select("a", "b").distinct()


def _placed(chosen: DataFrame, found: DataFrame) -> DataFrame:
    """``chosen`` with each set's component, and whether it is another one than that of the group's leader."""
    root = found.select(F.col("node").alias("lead"), F.col("component").alias("root"))
    rows = chosen.select("key", "unique", "node", "n", F.col("leader.node").alias("lead"), F.col("leader.n").alias("n_lead")).join(found, "node", "left").join(root, "lead", "left")
    return rows.withColumn("component", F.coalesce("component", "node")).withColumn("far", F.col("component") != F.coalesce("root", "lead")).drop("root")


def shingle_classes(docs: DataFrame, sample: int = SAMPLE, few: int = FEW) -> DataFrame:
    """(doc_id, n_shingles, component_id) for documents (doc_id, text), one row per input row.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; the set holds distinct
    5-word shingles, or the whole sequence of fewer words. Documents link when
    100 * intersection >= 80 * union; component_id is the smallest doc_id that
    links reach, itself included. NULL, empty and wordless texts have no set and
    link with nothing. Rows with a NULL doc_id take part; their component is the
    smallest id reached, NULL if there is none. Repeated rows link with their
    copies. Other columns are not read. An empty table gives an empty result.

    Equal sets are one node, whatever number of documents has it, so copies cost
    nothing after the first step. No cap is set on partners: segments shared by
    many sets are ordered last (exact counts), and in each group left over every
    set is compared with one leader first, and with one set that is not of the
    leader's component second. Sets still of other components than their leader's
    are compared with the whole group where there are at most ``few``; in other
    groups only with sets that differ from the leader in the same shingles. Both
    ways are exact.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    total, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text").cast("bigint"))).first()
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-(size or 0) // MEETING))
    heavy = _heavy_names(docs, sample, total, tasks * PASSES)
    # One exchange, in turns: how many sets have the segment. Names and nodes travel packed, so that a segment takes as many bytes in a table of any size.
    kept = reduce(DataFrame.union, [staged(_met(_rows(docs, heavy, turn, PASSES, tasks * PASSES), tasks, PASSES)) for turn in range(PASSES)])
    documents = kept.filter("kind = 0").select("doc_id", "node", "n")
    # Copies of a text are added up before they meet, so a text that a third of all documents has is one row per task.
    carriers = kept.filter("kind = 0 AND n > 0").groupBy("node", "n").agg(
        F.min("doc_id").alias("doc_id"), F.min("sketch").alias("sketch"), F.max("filled").alias("filled"), F.max("below").alias("below"))
    highest = F.length(F.bin("n")) - 1  # band_of(n)
    band = F.when(F.col("key") % 2 == highest % 2, highest).otherwise(highest - 1)
    shared = kept.filter("kind = 1").select("key", "node", "sets").join(carriers.select("node", "n", "filled", "below"), "node").select(
        "key", "node", "n", band.alias("band"), F.when(band == highest, F.col("filled")).otherwise(F.col("below")).alias("filled"), "sets")

    # Pigeonhole: of a set's filled segments, the d + 1 rarest. Those that no other set has are the rarest of all and need no row.
    own = Window.partitionBy("node", "band")
    ranked = shared.withColumn("live", F.count(F.lit(1)).over(own)).withColumn("rank", F.row_number().over(own.orderBy("sets", "key")))
    unique = F.col("filled") - F.col("live")
    chosen = ranked.filter(F.col("rank") <= _most_apart(F.col("n"), F.col("band")) + 1 - unique).select("key", "node", "n", unique.alias("unique"))
    sizes = chosen.groupBy("key").agg(F.count(F.lit(1)).alias("sets"), F.min(F.struct("unique", "node", "n")).alias("leader"))
    chosen = staged(chosen.join(sizes.filter("sets > 1"), "key").select("key", "unique", "node", "n", "leader"))

    nodes = staged(carriers.select("node", "n", "doc_id", "sketch").join(chosen.select("node").distinct(), "node", "left_semi"))

    links = _verified(_stars(chosen.withColumnRenamed("leader", "head")), nodes, docs)
    # Sets far from the leader, that is, not of its component, meet around one of them: all of the group is compared with that one too.
    placed = staged(_placed(chosen, components(links, "a", "b")))
    heads = placed.filter("far").groupBy("key").agg(F.min(F.struct("unique", "node", "n", "component")).alias("head"))
    more = _verified(_stars(placed.join(heads, "key").filter("component <> head.component")), nodes, docs)
    links = staged(links.union(more).distinct())

    # In a group with few sets still far each is compared with all of the group; other groups go by differences.
    placed = staged(_placed(chosen, components(links, "a", "b")))
    split = placed.filter("far").groupBy("key").agg(F.count(F.lit(1)).alias("far_sets"))
    placed = staged(placed.join(split, "key"))
    light = placed.filter(F.col("far_sets") <= few)
    met = _ends(light.filter("far"), "a", "key").join(_ends(light, "b", "key"), "key").filter(_apart()).select("a", "b").distinct()
    heavy = placed.filter((F.col("far_sets") > few) & (F.col("node") != F.col("lead"))).select("lead", "n_lead", "node", "n", "component", "far").distinct()
    more = _verified(met.union(_by_differences(heavy, nodes, docs)).distinct(), nodes, docs)
    classes = components(links.union(more), "a", "b")

    smallest = documents.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    labelled = smallest.join(classes, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    final = staged(labelled.join(least, "component").select("node", "component_id"))
    return documents.join(final, "node", "left").select(
        "doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_per_class(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: that of its smallest doc_id; all columns stay.

    Rows are kept or dropped each by its own text, so different texts under one
    id both stay unless they are linked. Rows without an id come after all ids.
    Of rows of a class with the same smallest id one stays. Texts without words
    are in no class, and all of their rows stay. Where ids are unique they name
    the rows; else the rows are numbered in a written copy. The texts are
    exchanged once, in the join that drops rows, or not at all where Spark can
    broadcast the dropped ids.
    """
    # The row travels as one struct, so its columns may have any names.
    held = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").alias("text"), F.struct("*").alias("row"))
    shared = held.groupBy("id").count().filter("id IS NULL OR count > 1")
    if shared.isEmpty():
        rows = held.select("row", "text", F.col("id").alias("number"))
        classes = shingle_classes(rows.select(F.col("number").alias("doc_id"), "text"))
        dropped = staged(classes.filter("doc_id <> component_id").select(F.col("doc_id").alias("gone")))
    else:
        rows = staged(held.withColumn("number", F.monotonically_increasing_id()))
        classes = shingle_classes(rows.select(F.col("number").alias("doc_id"), "text")).withColumnRenamed("doc_id", "number")
        classes = staged(classes.join(rows.select("number", "id"), "number").select("component_id", F.struct(F.col("id").isNull().alias("unnamed"), "id", "number").alias("place")))
        first = classes.groupBy("component_id").agg(F.min("place").alias("first"))
        dropped = staged(classes.join(first, "component_id").filter("place.number <> first.number").select(F.col("place.number").alias("gone")))
    return rows.join(dropped, F.col("number") == F.col("gone"), "left_anti").select("row.*")
