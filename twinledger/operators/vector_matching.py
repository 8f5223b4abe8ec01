"""Best cosine match between two tables of vectors: exact, in bounded blocks, emitting one row per left and block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import quoted
from .lineage import cut

# A right side up to this many vector elements goes to every task whole (16 MB of doubles), checked by a count.
SMALL_ELEMENTS = 2_000_000
# Rows of one block of either side in the blocked form, the least and largest number of centres right vectors gather around,
# and the most rings around a centre; the table of rings is what the driver and every task hold (131,072 rows).
BLOCK_ROWS = 4_096
CENTRES = 256
MOST_CENTRES = 8_192
MOST_RINGS = 16
# Left and right rows that meet in one task of the second pass: a row is sent once for as many rows of the other side as meet there,
# however small the blocks are.
LEFTS_SENT = 4_096
RIGHTS_SENT = 16_384

# Numbers in a table of angles at once.
TABLE = 2_000_000
# Angles are known to about 1e-7.
SLACK = 1e-6


def best_cosine_match(
    left: DataFrame, right: DataFrame, left_id: str, right_id: str, vector: str, threshold: float = 0.75,
    small_elements: int = SMALL_ELEMENTS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(left_id, right_id, cosine)``: for each left vector the right vector of the highest cosine, if it is
    above 0 and reaches the threshold. Ties go to the lower right id; vectors without length match nothing.
    """
    lefts = left.select(quoted(left_id).alias("left_id"), quoted(vector).alias("vector")).where(F.size("vector") > 0)
    rights = right.select(quoted(right_id).alias("right_id"), quoted(vector).alias("vector")).where(F.size("vector") > 0)
    size = rights.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("vector")), F.lit(0)).alias("elements")).first()
    schema = _schema(lefts, rights)
    if size["n"] == 0:
        return lefts.sparkSession.createDataFrame([], schema)
    if size["elements"] <= small_elements:
        return _against_list(lefts, rights, schema, threshold)
    return _in_blocks(lefts, rights, schema, threshold, block_rows, size["n"])


def _schema(lefts: DataFrame, rights: DataFrame) -> str:
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    return f"left_id {kind(lefts, 'left_id')}, right_id {kind(rights, 'right_id')}, cosine double"


def _unit_rows(vectors) -> np.ndarray:
    """Vectors as rows of length 1; vectors without length stay 0 and so have cosine 0."""
    rows = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    lengths = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, lengths, out=np.zeros_like(rows), where=lengths > 0)


def _best_in(left_ids, left_rows: np.ndarray, right_ids, right_rows: np.ndarray, threshold) -> pd.DataFrame:
    """The best right of each left within one block, if it reaches the threshold (one for all, or each left's own); right rows are
    in the order that settles ties."""
    cosines = left_rows @ right_rows.T
    best = cosines.argmax(axis=1)
    top = cosines[np.arange(len(best)), best]
    keep = (top > 0) & (top >= threshold)
    return pd.DataFrame({
        "left_id": np.asarray(left_ids)[keep], "right_id": np.asarray(right_ids)[best[keep]], "cosine": top[keep],
    })


def _against_list(lefts: DataFrame, rights: DataFrame, schema: str, threshold: float) -> DataFrame:
    rows = rights.orderBy("right_id").collect()
    shared = lefts.sparkSession.sparkContext.broadcast((np.array([r[0] for r in rows]), _unit_rows(r[1] for r in rows)))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, matrix = shared.value
        for batch in batches:
            for start in range(0, len(batch), 1_000):
                part = batch.iloc[start:start + 1_000]
                yield _best_in(part["left_id"], _unit_rows(part["vector"]), ids, matrix, threshold)

    return lefts.mapInPandas(best, schema)


def centre_count(rows: int, block_rows: int) -> int:
    """Centres grow with the rows, a block each, within what the driver and every task can hold."""
    return min(MOST_CENTRES, max(CENTRES, rows // block_rows))


def _in_blocks(lefts: DataFrame, rights: DataFrame, schema: str, threshold: float, block_rows: int, count: int) -> DataFrame:
    """Two passes: a left vector first meets one block near it, then only the blocks that may hold something as good.

    The best cosine of the first block is the left's own bound from then on, so how much is visited follows from how
    near the nearest vectors are, not from the threshold. Vectors are sent for groups of lefts, not for every visit.
    """
    around = RightBlocks(rights, count, block_rows)
    first = cut(around.first_visits(lefts.withColumn("bound", F.lit(float(threshold)))))
    near = cut(around.met(first, schema))
    known = near.select(F.col("left_id").alias("known_id"), F.col("cosine").alias("known"))
    known = known.groupBy("known_id").agg(F.max("known").alias("known"))
    bounded = first.join(known, F.col("left_id").eqNullSafe(F.col("known_id")), "left")
    bounded = bounded.withColumn("bound", F.greatest("bound", F.coalesce("known", "bound"))).drop("known_id", "known")
    met = near.unionByName(around.further_met(bounded, schema))
    best = F.min_by(F.struct("right_id", "cosine"), F.struct(-F.col("cosine"), F.col("right_id")))
    return met.groupBy("left_id").agg(best.alias("best")).select("left_id", "best.right_id", "best.cosine")


class RightBlocks:
    """Right vectors around centres, those of a centre in rings by their angle to it, and large rings in parts by hash.

    Angles obey the triangle inequality: a right vector within angle ``acos(bound)`` of a left one lies in a ring whose angles
    differ from the left's own angle to the centre by no more than that. Other rings are skipped without loss. A block
    (one part of a ring) holds about ``block_rows`` rows, however many vectors lie around one centre or in one direction.
    """

    UNIT = ["centre", "ring", "part"]

    def __init__(self, rights: DataFrame, count: int, block_rows: int):
        self.block_rows, self.spark = block_rows, rights.sparkSession
        drawn = rights.orderBy(F.xxhash64("right_id"), "right_id").limit(centre_count(count, block_rows)).collect()
        self.centres = self.spark.sparkContext.broadcast(_unit_rows(r["vector"] for r in drawn))
        gathered = cut(rights.mapInPandas(self._gathered(), _with(rights, "centre int, angle double")))
        # Borders between rings: quantiles of the angles, as many as the centre's rows ask for.
        steps = [i / MOST_RINGS for i in range(1, MOST_RINGS)]
        angles = gathered.groupBy("centre").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("angle", steps).alias("at"))
        rings = F.least(F.lit(MOST_RINGS), F.ceil(F.col("n") / block_rows))
        chosen = F.transform(F.sequence(F.lit(1), rings - 1), lambda i: F.element_at("at", F.ceil(i * MOST_RINGS / rings).cast("int")))
        borders = angles.select("centre", F.when(rings > 1, F.array_distinct(chosen)).otherwise(F.array().cast("array<double>")).alias("borders"))
        ringed = gathered.join(F.broadcast(borders), "centre").withColumn(
            "ring", F.size(F.filter("borders", lambda x: x < F.col("angle")))).drop("borders")
        rows = ringed.groupBy("centre", "ring").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).collect()
        rows = sorted((r["centre"], r["ring"], r["low"], r["high"], -(-r["n"] // block_rows), r["n"]) for r in rows)
        self.rings = pd.DataFrame(rows, columns=["centre", "ring", "low", "high", "parts", "n"])
        sizes = self.spark.createDataFrame([(c, k, p) for c, k, _, _, p, _ in rows], "centre int, ring int, parts int")
        self.placed = ringed.join(F.broadcast(sizes), ["centre", "ring"]).select(
            "right_id", "vector", "centre", "ring", F.pmod(F.xxhash64("right_id"), F.col("parts")).cast("int").alias("part"))

    def _gathered(self):
        centres = self.centres

        def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                cosines = np.clip(_unit_rows(batch["vector"]) @ centres.value.T, -1.0, 1.0)
                nearest = cosines.argmax(axis=1)
                angle = np.arccos(cosines[np.arange(len(nearest)), nearest])
                yield batch.assign(centre=nearest.astype("int32"), angle=angle)

        return gather

    def _visits(self, lefts: DataFrame, pick) -> DataFrame:
        """The lefts once per block that ``pick(angles to the rings' centres, bounds, rings)`` names, as rows of (left, ring)."""
        centres, shared, columns = self.centres, self.spark.sparkContext.broadcast(self.rings), lefts.columns
        schema = _with(lefts, "centre int, ring int, parts int")

        def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            table = shared.value
            of_centre = table["centre"].to_numpy()
            for batch in batches:
                unit = _unit_rows(batch["vector"])
                has_length = (unit != 0).any(axis=1)
                batch, unit = batch[has_length], unit[has_length]
                step = max(1, TABLE // max(len(table), len(centres.value)))
                for start in range(0, len(batch), step):
                    part = batch.iloc[start:start + step]
                    angles = np.arccos(np.clip(unit[start:start + step] @ centres.value.T, -1.0, 1.0))[:, of_centre]
                    left, ring = pick(angles, part["bound"].to_numpy(), table)
                    out = part[columns].iloc[left]
                    yield out.assign(**{c: table[c].to_numpy()[ring].astype("int32") for c in ("centre", "ring", "parts")})

        return lefts.mapInPandas(visit, schema)

    def first_visits(self, lefts: DataFrame) -> DataFrame:
        """Every left with one block: a part of the nearest centre's ring whose angles are nearest to its own."""

        def pick(angles, bounds, table):
            outside = np.maximum(0.0, np.maximum(table["low"].to_numpy() - angles, angles - table["high"].to_numpy()))
            # The nearest centre counts first, then the ring.
            nearest = angles.min(axis=1, keepdims=True)
            return np.arange(len(angles)), np.where(angles <= nearest, outside, np.inf).argmin(axis=1)

        return self._visits(lefts, pick).withColumn("part", F.pmod(F.xxhash64("left_id"), F.col("parts")).cast("int")).drop("parts")

    def further_visits(self, first: DataFrame) -> DataFrame:
        """Every left with each block that may hold a right vector within its bound, but for the block it has met."""

        def pick(angles, bounds, table):
            return np.nonzero(_open(angles, bounds, table["low"].to_numpy(), table["high"].to_numpy()))

        lefts = first.withColumnsRenamed({c: f"first_{c}" for c in self.UNIT})
        names = [f"first_{c}" for c in self.UNIT]
        shown = lefts.select("left_id", "vector", "bound", F.struct(*names).alias("met"))
        visits = self._visits(shown, pick).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        was_met = F.struct(*[F.col(c).alias(f"first_{c}") for c in self.UNIT]) == F.col("met")
        return visits.where(~was_met).select("left_id", "vector", "bound", *self.UNIT)

    def further_met(self, first: DataFrame, schema: str) -> DataFrame:
        """The best right of each left in all blocks that ``further_visits`` names, if it reaches the left's bound.

        Lefts that first visited near centres form groups, and the blocks of near centres form chunks. A group meets each chunk that holds a
        block for one of its lefts, and there every left the rings that its own bound leaves open.
        """
        rank = np.empty(len(self.centres.value), dtype=np.int64)
        rank[_near_order(self.centres.value)] = np.arange(len(rank))
        counts = first.groupBy("centre").agg(F.count(F.lit(1)).alias("n")).collect()
        counts = sorted(((r["centre"], r["n"]) for r in counts), key=lambda r: rank[r[0]])
        groups, number, held = [], 0, 0
        for centre, n in counts:
            if held and held + n > LEFTS_SENT:
                number, held = number + 1, 0
            groups.append((centre, number, -(-n // LEFTS_SENT)))
            held += n
        groups = self.spark.createDataFrame(groups, "centre int, left_group int, group_parts int")
        lefts = first.select("left_id", "vector", "bound", "centre").join(F.broadcast(groups), "centre").select(
            "left_id", "vector", "bound", "left_group", F.pmod(F.xxhash64("left_id", "vector"), "group_parts").cast("int").alias("left_part"))
        blocks = self.rings.assign(rank=rank[self.rings["centre"]]).sort_values(["rank", "ring"])
        blocks = blocks.loc[blocks.index.repeat(blocks["parts"])]
        part = blocks.groupby(["centre", "ring"]).cumcount()
        chunk = (blocks["n"] / blocks["parts"]).cumsum() // RIGHTS_SENT
        chunks = self.spark.createDataFrame(
            list(zip(*(c.astype(int).tolist() for c in (blocks["centre"], blocks["ring"], part, chunk)))), "centre int, ring int, part int, chunk int")
        visits = cut(lefts.mapInPandas(self._group_visits(), "left_group int, left_part int, centre int, ring int").distinct())
        meetings = visits.join(F.broadcast(chunks), ["centre", "ring"]).select("left_group", "left_part", "chunk").distinct()
        rights = self.placed.join(F.broadcast(chunks), self.UNIT).select("right_id", "vector", "centre", "ring", "chunk").join(visits, ["centre", "ring"])
        lefts = lefts.join(meetings, ["left_group", "left_part"])
        # As in met, new names keep the columns of both sides apart.
        keys = ["left_group", "left_part", "chunk"]
        lefts = lefts.select(*[F.col(c).alias(c) for c in ("left_id", "vector", "bound", *keys)])
        rights = rights.select(*[F.col(c).alias(c) for c in ("right_id", "vector", "centre", "ring", *keys)])
        centres = self.centres

        def compare(left_block: pd.DataFrame, right_block: pd.DataFrame) -> pd.DataFrame:
            if left_block.empty or right_block.empty:
                return pd.DataFrame({"left_id": [], "right_id": [], "cosine": []})
            right_block = right_block.sort_values("right_id")
            lefts, rights = _unit_rows(left_block["vector"]), _unit_rows(right_block["vector"])
            bounds = left_block["bound"].to_numpy()
            top, at = bounds.copy(), np.full(len(lefts), -1)
            for (centre, _), rows in right_block.groupby(["centre", "ring"]).indices.items():
                # The rows come in rising order, so the first of equal cosines has the lowest id.
                rows, middle = np.sort(rows), centres.value[centre]
                own = np.arccos(np.clip(rights[rows] @ middle, -1.0, 1.0))
                angles = np.arccos(np.clip(lefts @ middle, -1.0, 1.0))[:, None]
                near = np.flatnonzero(_open(angles, bounds, own.min(), own.max()))
                step = max(1, 8 * TABLE // len(rows))
                for start in range(0, len(near), step):
                    some = near[start:start + step]
                    cosines = lefts[some] @ rights[rows].T
                    best = cosines.argmax(axis=1)
                    value, place = cosines[np.arange(len(some)), best], rows[best]
                    better = (value > 0) & ((value > top[some]) | (value == top[some]) & ((at[some] < 0) | (place < at[some])))
                    top[some[better]], at[some[better]] = value[better], place[better]
            found = at >= 0
            return pd.DataFrame({
                "left_id": left_block["left_id"].to_numpy()[found], "right_id": right_block["right_id"].to_numpy()[at[found]], "cosine": top[found]})

        return lefts.groupBy(*keys).cogroup(rights.groupBy(*keys)).applyInPandas(compare, schema)

    def _group_visits(self):
        """The rings that the bounds of a batch leave open, once for each group of its lefts."""
        centres, shared = self.centres, self.spark.sparkContext.broadcast(self.rings)

        def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            table = shared.value
            of_centre, ring, low, high = (table[c].to_numpy() for c in ("centre", "ring", "low", "high"))
            step = max(1, TABLE // max(len(table), len(centres.value)))
            for batch in batches:
                batch = batch.sort_values(["left_group", "left_part"])
                for start in range(0, len(batch), step):
                    some = batch.iloc[start:start + step]
                    unit = _unit_rows(some["vector"])
                    angles = np.arccos(np.clip(unit @ centres.value.T, -1.0, 1.0))[:, of_centre]
                    # Vectors without length match nothing.
                    meets = _open(angles, some["bound"].to_numpy(), low, high) & (unit != 0).any(axis=1)[:, None]
                    begins = np.flatnonzero(~some.duplicated(["left_group", "left_part"]).to_numpy())
                    group, which = np.nonzero(np.logical_or.reduceat(meets, begins, axis=0))
                    names = some.iloc[begins[group]]
                    yield pd.DataFrame({
                        "left_group": names["left_group"].to_numpy(), "left_part": names["left_part"].to_numpy(),
                        "centre": of_centre[which].astype("int32"), "ring": ring[which].astype("int32")})

        return visit

    def met(self, visits: DataFrame, schema: str) -> DataFrame:
        """The best right of each left in each block it visits, if it reaches the left's bound.

        The lefts of a block are cut into parts of ``block_rows`` by their count, and the block is copied once for each part.
        """
        parts = visits.groupBy(*self.UNIT).agg(F.ceil(F.count(F.lit(1)) / self.block_rows).cast("int").alias("left_parts"))
        lefts = visits.join(parts, self.UNIT).withColumn("left_part", F.pmod(F.xxhash64("left_id"), F.col("left_parts")).cast("int"))
        rights = self.placed.join(parts, self.UNIT).withColumn("left_part", F.explode(F.sequence(F.lit(0), F.col("left_parts") - 1)))
        # Both sides come from frames that are joined with themselves above; new names keep their columns apart.
        lefts = lefts.select(*[F.col(c).alias(c) for c in ("left_id", "vector", "bound", *self.UNIT, "left_part")])
        rights = rights.select(*[F.col(c).alias(c) for c in ("right_id", "vector", *self.UNIT, "left_part")])

        def compare(left_block: pd.DataFrame, right_block: pd.DataFrame) -> pd.DataFrame:
            if left_block.empty or right_block.empty:
                return pd.DataFrame({"left_id": [], "right_id": [], "cosine": []})
            right_block = right_block.sort_values("right_id")
            rights = _unit_rows(right_block["vector"])
            # A hash may leave a part larger than planned, so the table of cosines is cut as well.
            step, found = max(1, 8 * TABLE // len(rights)), []
            for start in range(0, len(left_block), step):
                part = left_block.iloc[start:start + step]
                found.append(_best_in(part["left_id"], _unit_rows(part["vector"]), right_block["right_id"], rights, part["bound"].to_numpy()))
            return pd.concat(found)

        keys = [*self.UNIT, "left_part"]
        return lefts.groupBy(*keys).cogroup(rights.groupBy(*keys)).applyInPandas(compare, schema)


def _open(angles: np.ndarray, bounds: np.ndarray, low, high) -> np.ndarray:
    """Whether rings of angles from low to high may hold a vector within each left's bound, by the lefts' angles to the rings' centres."""
    reach = np.arccos(np.clip(bounds, -1.0, 1.0))[:, None] + SLACK
    return (angles <= high + reach) & (angles >= low - reach)


def _near_order(centres: np.ndarray) -> np.ndarray:
    """The centres in an order that has near ones side by side: halved again and again along the direction in which they differ most."""
    order, open_parts = [], [np.arange(len(centres))]
    while open_parts:
        part = open_parts.pop()
        if len(part) <= 2:
            order.extend(part)
            continue
        rows = centres[part] - centres[part].mean(axis=0)
        along = rows[np.abs(rows).sum(axis=1).argmax()]
        for _ in range(8):
            along = rows.T @ (rows @ along)
            along = along / max(np.linalg.norm(along), 1e-300)
        part = part[np.argsort(rows @ along, kind="stable")]
        open_parts += [part[len(part) // 2:], part[:len(part) // 2]]
    return np.array(order, dtype=np.int64)


def _with(df: DataFrame, extra: str) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields) + ", " + extra
