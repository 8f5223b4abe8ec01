"""Near-duplicate groups by an LSH forest over MinHash signatures.

1. Every document becomes its set of word shingles; documents with equal sets form a class, represented by its least doc_id.
2. A signature of trees * depth MinHash values is cut into `trees` orders (keys of `depth` values). Sorted by one of these
   keys, documents with a long common prefix stand side by side. A region is a run with a common prefix: of `first_depth` values
   where that holds at most `region` documents, of more values where the order is denser (LEVELS), so the depth follows
   the density. Regions that stay larger at full depth are cut by hash, and each of their documents is
   also compared with the region's least document. That only gives components early; step 4 does the rest.
3. Candidates are the pairs of a region whose signatures agree enough. First every document meets its most similar earlier
   neighbour; links are confirmed on the full sets, and components formed. Then *all* remaining candidate pairs between
   different components are tried too, so no link between a region's documents that would change a component is left out. They
   aren't written: documents that are in such a pair take their full sets to the region, whose task finds the sizes of all
   intersections at once and gives as few links as join what the region's links join.
4. Documents of a region that was larger than `region` at first_depth, and holds several components by now, meet once more, whatever
   deeper orders did to them: two signatures that agree enough share one of their rarest values (prefix filter), so the documents
   of such a value meet, in blocks of bounded size, but for pairs inside its most frequent component. A pair counts in the block
   of the first value that both share, and is tried there as in step 3.

Tables in between are narrow (ids, prefixes, one byte per MinHash value); texts are read for candidates only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import components
from .shared import keep_ids, kept_table, small_side, text_of
from .textscan import LOWER, U64, give_back, mix, slices, window_sums, word_hashes, words

#: Slots by which values of signatures are counted, and how many shingles a task marks at a time.
SLOTS, COLUMNS = 1 << 18, 4096


@dataclass(frozen=True)
class Forest:
    shingle: int = 3
    percent: int = 85
    trees: int = 12
    depth: int = 8
    levels: tuple[int, ...] = (3, 5, 8)
    region: int = 64
    seed: int = 5

    def least_agreement(self) -> int:
        """Signature values that must agree before sets are compared: four standard deviations under the wanted similarity."""
        n, p = self.trees * self.depth, self.percent / 100
        return int(n * p - 4 * (n * p * (1 - p)) ** 0.5)


def shingle_sets(data: np.ndarray, offs: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle fingerprints of each document; fewer words than `width` form one shingle, none give none."""
    data = LOWER[data]
    starts, ends, first = words(data, offs)
    hashes = word_hashes(data, starts, ends)
    runs = window_sums(hashes, width)
    sets = []
    for d in range(len(offs) - 1):
        lo, n = int(first[d]), int(first[d + 1] - first[d])
        if n >= width:
            sets.append(np.unique(runs[lo:lo + n - width + 1]))
        elif n:
            sets.append(mix(window_sums(hashes[lo:lo + n], n) + U64(n)))
        else:
            sets.append(np.zeros(0, U64))
    return sets


def _signature_table(docs: DataFrame, forest: Forest) -> DataFrame:
    """doc_id, n_shingles, set_hash (of the whole set) and signature (little-endian 32-bit MinHash values)."""
    rng = np.random.default_rng(forest.seed)
    n = forest.trees * forest.depth
    factor = rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    shift = rng.integers(0, 2**32, n, dtype=np.uint32)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in batches:
            for lo, hi, data, offs in slices(b.column(1)):
                counts, digests, signatures = [], [], []
                for got in shingle_sets(data, offs, forest.shingle):
                    counts.append(len(got))
                    digests.append(hashlib.blake2b(got.tobytes(), digest_size=16).digest())
                    least = np.full(n, 0xFFFFFFFF, np.uint32)
                    low = (got >> U64(32)).astype(np.uint32)[:, None]
                    for k in range(0, len(low), 512):
                        np.minimum(least, (low[k:k + 512] * factor + shift).min(0), out=least)
                    signatures.append(least.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())],
                    ["doc_id", "n_shingles", "set_hash", "signature"])

    return text_of(docs).mapInArrow(sign, "doc_id long, n_shingles long, set_hash binary, signature binary")


def _prefixes(classes: DataFrame, forest: Forest) -> DataFrame:
    """id, and for each tree a row with the fingerprint of the tree and each prefix length in levels (p0, p1, ...)."""
    trees, depth, levels = forest.trees, forest.depth, forest.levels

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = np.frombuffer(b"".join(b.column(1).to_pylist()), "<u4").reshape(-1, trees, depth).astype(U64)
            ids = np.repeat(b.column(0).to_numpy(zero_copy_only=False), trees)
            run, marks = np.tile(mix(np.arange(1, trees + 1, dtype=U64)), (len(values), 1)), []
            for k in range(max(levels)):
                run = mix(run * U64(31) + values[:, :, k])
                if k + 1 in levels:
                    marks.append(pa.array(run.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(ids), *marks], ["id", *[f"p{i}" for i in range(len(marks))]])

    kinds = ", ".join(f"p{i} long" for i in range(len(levels)))
    return classes.select("id", "signature").mapInArrow(cut, f"id long, {kinds}")


def _regions(prefixes: DataFrame, forest: Forest) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(region, id) for the documents of every region with company, (a, b) for those of regions too large at full depth, and
    (region, id) for those of regions too large at the first depth."""
    left, found, stars, crowded = prefixes, [], None, None
    for level in range(len(forest.levels)):
        key, last = f"p{level}", level + 1 == len(forest.levels)
        sizes = left.groupBy(key).agg(F.count("*").alias("size"), F.min("id").alias("least")).filter("size > 1")
        left = kept_table(left.join(sizes, key).select("id", *[f"p{i}" for i in range(level, len(forest.levels))], "size", "least"), "regions")
        found.append(left.filter(F.col("size") <= forest.region).select(F.col(key).alias("region"), "id"))
        large = left.filter(F.col("size") > forest.region)
        if not level:
            crowded = large.select(F.col(key).alias("region"), "id")
        if last:
            chunk = F.pmod(F.xxhash64(key, "id"), F.ceil(F.col("size") * 2 / forest.region))
            found.append(large.select(F.xxhash64(key, chunk).alias("region"), "id"))
            stars = large.filter("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b"))
        left = large.drop(key, "size", "least")
    rows = found[0]
    for more in found[1:]:
        rows = rows.union(more)
    return rows, stars, crowded


def _several(rows: DataFrame) -> DataFrame:
    """The regions of rows (region, label, ...) that hold different labels."""
    return rows.groupBy("region").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("region")


def _rarest(classes: DataFrame, forest: Forest) -> DataFrame:
    """(id, n, marks, rarest): the rarest values of each signature in ascending order, so many that two signatures which agree enough
    share one of them; marks as in _byte_marks.

    Any order of the values that all documents share will do. Values are counted by slot (their low bits), so the counts that
    go to the tasks are of fixed size; slots of at most `region` documents are not counted apart.
    """
    n = forest.trees * forest.depth
    place = mix(np.arange(1, n + 1, dtype=U64))
    slots = U64(SLOTS - 1)

    def values_of(part: pa.RecordBatch) -> np.ndarray:
        return mix(np.frombuffer(b"".join(part.column(1).to_pylist()), "<u4").reshape(-1, n).astype(U64) * U64(31) + place)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (b.slice(lo, 1024) for b in batches for lo in range(0, len(b), 1024))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(SLOTS, np.int64)
        for part in parts(batches):
            held += np.bincount((values_of(part) & slots).astype(np.int64).reshape(-1), minlength=SLOTS)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], ["slot", "n"])

    signed = classes.select("id", "signature", "n")
    held = np.zeros(SLOTS, np.uint32)
    # At most SLOTS rows, whatever the input.
    for slot, times in signed.mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).filter(F.col("n") > forest.region).collect():
        held[slot] = min(times, 0xFFFFFFFF)
    wanted = n - forest.least_agreement() + 1

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            values = values_of(part)
            order = np.lexsort((values, held[(values & slots).astype(np.int64)]))[:, :wanted]
            chosen = np.take_along_axis(values, order, 1).view(np.int64)
            offsets = pa.array(np.arange(0, chosen.size + 1, chosen.shape[1]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), _thin(part.column(1)), pa.ListArray.from_arrays(offsets, pa.array(chosen.reshape(-1)))],
                ["id", "n", "marks", "rarest"])

    return signed.mapInArrow(choose, "id long, n long, marks binary, rarest array<long>")


def _blocks(rows: DataFrame, forest: Forest) -> DataFrame:
    """(region, id, label, value, side) from rows (region, id, label): every two documents of a region with different labels meet once in
    a new region, `value` being the old one. A large region is cut into chunks by hash, those of its most frequent label and those of
    the others; chunks of the others meet all chunks, so the frequent label's documents aren't paired with each other.
    Documents of a new region meet if their sides differ or are -1."""
    half = 4 * forest.region
    each = rows.groupBy("region", "label").agg(F.count("*").alias("n"))
    sizes = each.groupBy("region").agg(F.sum("n").alias("size"), F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("labels")).filter("labels > 1")
    sized = kept_table(rows.join(sizes.select("region", "size", F.col("top.n").alias("most"), F.col("top.label").alias("main")), "region"), "sized")
    small = sized.filter(F.col("size") <= 2 * half).select("region", "id", "label", F.col("region").alias("value"), F.lit(-1).alias("side"))
    large = sized.filter(F.col("size") > 2 * half).withColumns({
        "mains": F.ceil(F.col("most") / half), "others": F.ceil((F.col("size") - F.col("most")) / half), "is_main": F.col("label") == F.col("main")})
    large = large.withColumn("chunk", F.pmod(F.xxhash64("id"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others"))))
    met = F.expr("""CASE WHEN is_main THEN transform(sequence(0L, others - 1), o -> struct(0 AS kind, chunk AS x, o AS y, 0 AS side))
      ELSE concat(transform(sequence(0L, mains - 1), m -> struct(0 AS kind, m AS x, chunk AS y, 1 AS side)),
                  transform(sequence(0L, others - 1), o -> struct(1 AS kind, least(chunk, o) AS x, greatest(chunk, o) AS y,
                                                                  CASE WHEN chunk < o THEN 0 WHEN chunk > o THEN 1 ELSE -1 END AS side))) END""")
    spread = large.select("region", "id", "label", F.explode(met).alias("m"))
    return small.union(spread.select(F.xxhash64("region", "m.kind", "m.x", "m.y").alias("region"), "id", "label", F.col("region").alias("value"), "m.side"))


def _by_region(rows: DataFrame, work, schema: str) -> DataFrame:
    """work(table) of tables that hold whole regions, in order of id. A region is bounded, and no key is hot."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            region = t.column("region").to_numpy()
            whole = int(np.searchsorted(region, region[-1])) if len(region) else 0
            if whole:
                yield work(t.slice(0, whole))
            held = t.slice(whole)
        if held is not None and len(held):
            yield work(held)
        held = None
        give_back()

    return rows.repartition("region").sortWithinPartitions("region", "id").mapInArrow(run, schema)


def _alike(t: pa.Table, forest: Forest, fits=None) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(i, agree, lag): the rows i that meet row i + lag of their region, which fit, whose signatures and sizes allow the wanted
    similarity, and in how many values they agree; by ascending lag."""
    least, percent = forest.least_agreement(), forest.percent
    region, ids, size = (t.column(c).to_numpy() for c in ("region", "id", "n"))
    marks = np.frombuffer(b"".join(t.column("marks").to_pylist()), np.uint8).reshape(len(ids), -1)
    lag, at = 1, np.arange(len(ids))
    while True:
        # A row that meets nothing at this distance meets nothing further on.
        at = at[at + lag < len(ids)]
        at = at[region[at] == region[at + lag]]
        if not len(at):
            return
        i = at[(ids[at] != ids[at + lag]) & (100 * np.minimum(size[at], size[at + lag]) >= percent * np.maximum(size[at], size[at + lag]))]
        if fits is not None:
            i = i[fits(i, i + lag)]
        if len(i):
            agree = (marks[i] == marks[i + lag]).sum(1)
            if (agree >= least).any():
                yield i[agree >= least], agree[agree >= least], lag
        lag += 1


def _nearest(members: DataFrame, forest: Forest) -> DataFrame:
    """(a, b), a < b, possibly repeated, from rows (region, id, n, marks): each document's most similar earlier neighbour in a region."""
    def pair(t: pa.Table) -> pa.RecordBatch:
        ids = t.column("id").to_numpy()
        best, whom = np.zeros(len(ids), np.int64), np.full(len(ids), -1)
        for i, agree, lag in _alike(t, forest):
            better = agree > best[i + lag]
            best[i[better] + lag], whom[i[better] + lag] = agree[better], i[better]
        two, one = ids[whom >= 0], ids[whom[whom >= 0]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))], ["a", "b"])

    return _by_region(members, pair, "a long, b long")


def _undecided(members: DataFrame, forest: Forest) -> DataFrame:
    """The (region, id, label) of members (region, id, label, n, marks) that are in a pair of different labels whose signatures and
    sizes allow the wanted similarity. With columns value, side and rarest, as in step 4: a pair counts where value is the first
    of the rarest values that both share, if its sides differ or are -1."""
    blocks = "value" in members.columns

    def take(t: pa.Table) -> pa.RecordBatch:
        label = t.column("label").to_numpy()
        side = t.column("side").to_numpy() if blocks else None
        wanted = np.zeros(len(label), bool)

        def fits(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            apart = label[i] != label[j]
            return apart & ((side[i] < 0) | (side[i] != side[j])) if blocks else apart

        if blocks:
            value = t.column("value").to_numpy()
            rarest = t.column("rarest").combine_chunks().flatten().to_numpy().reshape(len(label), -1)
        for i, _, lag in _alike(t, forest, fits):
            if blocks:
                i = i[~(wanted[i] & wanted[i + lag])]
                for lo in range(0, len(i), 2048):
                    k = i[lo:lo + 2048]
                    # Both are in one order of all values, so the first value of one that the other has is the first that both share.
                    shared = (rarest[k][:, :, None] == rarest[k + lag][:, None, :]).any(2)
                    first = rarest[k, shared.argmax(1)]
                    k = k[first == value[k]]
                    wanted[k] = wanted[k + lag] = True
            else:
                wanted[i] = wanted[i + lag] = True
        rows = np.flatnonzero(wanted)
        region, ids = t.column("region").to_numpy()[rows], t.column("id").to_numpy()[rows]
        # A doc_id with several sets has several rows.
        new = np.concatenate([[True], (region[1:] != region[:-1]) | (ids[1:] != ids[:-1])])[:len(rows)]
        return pa.RecordBatch.from_arrays([pa.array(region[new]), pa.array(ids[new]), pa.array(label[rows][new])], ["region", "id", "label"])

    return _by_region(members, take, "region long, id long, label long")


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements every two of the sets share; COLUMNS of the elements that several sets hold at a time."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    elements = np.concatenate(sets)
    order = np.argsort(elements, kind="stable")
    owner, elements = owner[order], elements[order]
    column = np.cumsum(np.concatenate([[False], elements[1:] != elements[:-1]])) if len(elements) else np.zeros(0, np.int64)
    several = np.bincount(column) > 1
    kept = several[column]
    owner, column = owner[kept], (np.cumsum(several) - 1)[column[kept]]
    both = np.zeros((len(sets), len(sets)))
    for lo in range(0, int(several.sum()), COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + COLUMNS])
        grid = np.zeros((len(sets), COLUMNS), np.float32)
        grid[owner[a:b], column[a:b] - lo] = 1
        both += grid @ grid.T
    return both


def _joining(labels: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """As few of the linked pairs (a matrix) as join the same labels."""
    parent = {x: x for x in labels.tolist()}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    kept = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(linked, 1) & (labels[:, None] != labels)))):
        a, b = root(labels[i].item()), root(labels[j].item())
        if a != b:
            parent[b] = a
            kept.append((i, j))
    return kept


def _links_of_regions(rows: DataFrame, docs: DataFrame, forest: Forest) -> DataFrame:
    """(a, b), possibly repeated, from rows (region, id, label): pairs whose whole sets reach the similarity, so many that labels which the links within a
    region join are joined. All pairs of a region are tried; texts are read once, and the sets go to the regions."""
    wanted = kept_table(rows.select(F.col("id").alias("doc_id")).distinct(), "ids")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in slices(b.column(1)):
                sets = [s.tobytes() for s in shingle_sets(data, offs, forest.shingle)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(sets, pa.binary())], ["id", "shingles"])
        give_back()

    sets = kept_table(docs.join(small_side(wanted), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(shingle, "id long, shingles binary").filter("octet_length(shingles) > 0"), "sets")
    percent = forest.percent

    def link(t: pa.Table) -> pa.RecordBatch:
        region, ids, label = (t.column(c).to_numpy() for c in ("region", "id", "label"))
        shingles = t.column("shingles")
        edges = np.flatnonzero(np.concatenate([[True], region[1:] != region[:-1], [True]]))
        one, two = [], []
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
            # Rows that repeat a doc_id and its text are one.
            first = {x: k for k, x in reversed(list(enumerate(zip(ids[lo:hi].tolist(), shingles.slice(lo, hi - lo).to_pylist()), lo)))}
            at = np.array(sorted(first.values()))
            if len(at) < 2:
                continue
            held = [np.frombuffer(shingles[k].as_py(), U64) for k in at.tolist()]
            both, size = _intersections(held), np.array([len(x) for x in held], np.int64)
            linked = (both > 0) & (100 * both >= percent * (size[:, None] + size - both))
            for i, j in _joining(label[at], linked):
                one.append(ids[at[i]])
                two.append(ids[at[j]])
        a, b = np.array(one, np.int64), np.array(two, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return _by_region(rows.join(sets, "id"), link, "a long, b long")


def _confirmed(pairs: DataFrame, docs: DataFrame, forest: Forest) -> DataFrame:
    """The pairs whose whole sets reach the similarity; only texts that occur in a pair are moved."""
    ids = kept_table(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "ids")
    texts = kept_table(docs.join(small_side(ids), "doc_id", "left_semi").select("doc_id", "text"), "texts")
    joined = (pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
              .join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b"))
    percent = forest.percent

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in slices(batch.column(2)):
                ones = shingle_sets(data, offs, forest.shingle)
                rest = batch.slice(lo, hi - lo)
                at, kept = 0, []
                for low, high, more, ends in slices(rest.column(3)):
                    for i, two in enumerate(shingle_sets(more, ends, forest.shingle), low):
                        both = len(np.intersect1d(ones[i], two, assume_unique=True))
                        if both and 100 * both >= percent * (len(ones[i]) + len(two) - both):
                            kept.append(i)
                yield rest.select([0, 1]).take(pa.array(kept, pa.int64()))

    return joined.select("a", "b", "text_a", "text_b").mapInArrow(confirm, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, forest: Forest = Forest()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least doc_id that can be reached over links) and kept
    (doc_id = component_id).

    Documents are linked if their shingle sets have 100 * intersection >= percent * union. Null or empty texts, and texts
    without words, have the empty set and no link. Rows that repeat a doc_id give a row each; whatever text they have, the
    doc_id is one node. A null doc_id can't be linked: its component_id is null and it is kept. Further columns are left
    out; an empty table gives no rows.
    """
    docs = text_of(docs)
    signed = kept_table(_signature_table(docs, forest), "signatures")
    known = signed.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes = kept_table(
        known.groupBy("set_hash").agg(F.min("doc_id").alias("id"), F.max("n_shingles").alias("n"), F.first("signature").alias("signature")), "classes")
    regions, stars, crowded = _regions(_prefixes(classes, forest), forest)
    marks = _byte_marks(classes)
    members = kept_table(regions.join(marks, "id"), "members")
    stars = _agreeing(stars.distinct(), marks, forest)
    links = kept_table(_confirmed(kept_table(_nearest(members, forest).union(stars).distinct(), "pairs"), docs, forest), "links")
    # Ids of equal sets and repeated doc_ids with several sets count as links too.
    equal = known.join(classes.select("set_hash", "id"), "set_hash").filter("doc_id <> id").select(F.col("id").alias("a"), F.col("doc_id").alias("b")).distinct()
    labels = components(links)
    second = members.join(labels, "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
    rest = kept_table(_undecided(second.join(_several(second), "region", "left_semi"), forest), "undecided")
    # Labels hold what the links before them join, so the next components begin from these.
    links = labels.select(F.col("id").alias("a"), F.col("component").alias("b"))
    if not rest.isEmpty():
        links = links.union(kept_table(_links_of_regions(rest, docs, forest), "links"))
    if not crowded.isEmpty():
        labels = components(links)
        links = labels.select(F.col("id").alias("a"), F.col("component").alias("b"))
        crowded = crowded.join(labels, "id", "left").select("region", "id", F.coalesce("component", "id").alias("label"))
        ids = kept_table(crowded.join(_several(crowded), "region", "left_semi").select("id", "label").distinct(), "crowded")
        if not ids.isEmpty():
            rarest = kept_table(_rarest(classes.join(ids, "id", "left_semi"), forest), "rarest")
            met = rarest.join(ids, "id").select(F.explode("rarest").alias("region"), "id", "label")
            rest = kept_table(_undecided(_blocks(met, forest).join(rarest, "id"), forest), "undecided")
            links = links.union(_links_of_regions(rest, docs, forest))
    found = components(links.union(equal))
    return signed.join(found, signed["doc_id"] == found["id"], "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"))


def _thin(signatures: pa.Array) -> pa.Array:
    """One byte of each value."""
    values = np.frombuffer(b"".join(signatures.to_pylist()), np.uint8).reshape(len(signatures), -1)[:, ::4]
    return pa.array([x.tobytes() for x in values], pa.binary())


def _byte_marks(classes: DataFrame) -> DataFrame:
    """id, n and one byte of each signature value."""
    def thin(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _thin(b.column(2))], ["id", "n", "marks"])

    return kept_table(classes.select("id", "n", "signature").mapInArrow(thin, "id long, n long, marks binary"), "marks")


def _agreeing(pairs: DataFrame, marks: DataFrame, forest: Forest) -> DataFrame:
    """The pairs whose signatures agree enough."""
    least = forest.least_agreement()

    def check(batches):
        for b in batches:
            one, two = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(len(b), -1) for i in (2, 3))
            yield b.select([0, 1]).filter(pa.array((one == two).sum(1) >= least))

    both = (pairs.join(marks.select(F.col("id").alias("a"), F.col("marks").alias("ma")), "a")
            .join(marks.select(F.col("id").alias("b"), F.col("marks").alias("mb")), "b"))
    return both.select("a", "b", "ma", "mb").mapInArrow(check, "a long, b long")


def representatives(docs: DataFrame, forest: Forest = Forest()) -> DataFrame:
    """The rows of docs, columns unchanged, whose document is the least of its component (or has no doc_id)."""
    return keep_ids(docs, near_duplicates(docs, forest).filter("kept").select("doc_id"))
