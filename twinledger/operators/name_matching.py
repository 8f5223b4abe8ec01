"""Best fuzzy match between two lists of names, of any size, without comparing all pairs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import indel_percent, indel_percents, token_sorted
from ..functions.text import quoted
from .lineage import cut

# Scores of the equal and equal-but-for-case steps, and of the first matching stage.
EXACT, SAME_LETTERS, FIRST_STAGE = 100, 99, 85

# Up to this many different names on the right the whole list is sent to every task (checked by a count).
SMALL_LIST = 1_000
MAX_NAME = 1_000

# Similarity levels searched in turn: most names are settled at a high level, where candidates are few.
LEVELS = (94, 85, 72)

# Letters in a signature by level: (common letters needed at least, letters). More letters make fewer candidates but
# more signatures, the more so the less similar or the longer the texts are.
SIGNATURE_SIZES = {
    94: ((64, 3), (32, 4), (8, 6), (2, 2), (1, 1)),
    85: ((48, 2), (20, 3), (8, 4), (2, 2), (1, 1)),
    72: ((24, 2), (8, 3), (2, 2), (1, 1)),
}

# Meetings of one signature in a task; signatures with more are cut into parts.
PAIRS_IN_TASK = 1_000_000

BEST = "left_name string, right_name string, score int"


def names_of(df: DataFrame, name: str, order: str | None = None) -> DataFrame:
    """``(name, place)``: every different name once, with its place (the order column, or the name itself)."""
    place = quoted(order) if order else quoted(name)
    rows = df.select(quoted(name).cast("string").alias("name"), place.alias("place")).where(F.col("name").isNotNull())
    return rows.groupBy("name").agg(F.min("place").alias("place"))


def column_names(df: DataFrame) -> DataFrame:
    """The column names of a table as a name list, in their order: the input for mapping suggestions."""
    return df.sparkSession.createDataFrame(list(zip(df.columns, range(len(df.columns)))), "name string, place int")


def best_fuzzy_match(left: DataFrame, right: DataFrame, threshold: int = 60, small_list: int = SMALL_LIST) -> DataFrame:
    """``(left_name, right_name, score)``: the best right of each left, each right kept by its best left.

    ``left`` and ``right`` come from ``names_of`` or ``column_names``. Equal names score 100, equal but for
    case 99, others by similarity of their sorted words. A left whose best right goes to a better left stays
    unmatched. Ties go to the earlier name. ``small_list`` is the count of right names up to which they go to every task;
    the result doesn't depend on it.
    """
    return _one_left_per_right(best_right_per_left(left, right, min(FIRST_STAGE, threshold), small_list), left)


def best_right_per_left(left: DataFrame, right: DataFrame, threshold: int, small_list: int = SMALL_LIST) -> DataFrame:
    """The best right name of each left name with at least the threshold (1-100)."""
    if not 1 <= threshold <= 100:
        raise ValueError("threshold is between 1 and 100")
    exact = left.join(right.select("name"), "name", "left_semi").select(
        F.col("name").alias("left_name"), F.col("name").alias("right_name"), F.lit(EXACT).alias("score")
    )
    rest = left.join(right.select("name"), "name", "left_anti").withColumn("letters", F.lower("name"))
    letters = right.groupBy(F.lower("name").alias("letters")).agg(F.min_by("name", F.struct("place", "name")).alias("right_name"))
    same = rest.join(letters, "letters").select(
        F.col("name").alias("left_name"), "right_name", F.lit(SAME_LETTERS).alias("score")
    )
    open_names = rest.join(letters, "letters", "left_anti").select("name", F.expr(f"{token_sorted('name')} AS words"))
    open_names = open_names.where(F.col("words") != "")
    # The score depends on the sorted words only, so each wording is matched once and stands for all its names.
    wordings = right.groupBy(F.expr(f"{token_sorted('name')} AS words")).agg(
        F.min(F.struct("place", "name")).alias("first")
    ).select("words", F.col("first.name").alias("name"), F.col("first.place").alias("place")).where(F.col("words") != "")
    fuzzy = _fuzzy(open_names, wordings, threshold, small_list)
    return exact.unionByName(same).unionByName(fuzzy)


def _one_left_per_right(best: DataFrame, left: DataFrame) -> DataFrame:
    ranked = best.join(left.select(F.col("name").alias("left_name"), "place"), "left_name")
    first = F.min_by(F.struct("left_name", "score"), F.struct(-F.col("score"), F.col("place"), F.col("left_name")))
    kept = ranked.groupBy("right_name").agg(first.alias("kept"))
    return kept.select("kept.left_name", "right_name", "kept.score")


def _fuzzy(open_names: DataFrame, wordings: DataFrame, threshold: int, small_list: int) -> DataFrame:
    size = wordings.agg(F.count(F.lit(1)).alias("n"), F.max(F.length("words")).alias("longest")).first()
    if size["n"] <= small_list and (size["longest"] or 0) <= MAX_NAME:
        return _against_list(open_names, wordings, threshold)
    return _against_table(open_names, wordings, threshold)


def _against_list(open_names: DataFrame, wordings: DataFrame, threshold: int) -> DataFrame:
    """A right side of checked size goes to every task as a list; the left side is not shuffled."""
    rows = wordings.orderBy("place", "name").collect()
    rights = open_names.sparkSession.sparkContext.broadcast([(r.words, r.name) for r in rows])

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for name, words in zip(batch["name"], batch["words"]):
                top, top_name = threshold - 1, None
                for other, other_name in rights.value:
                    longest, shortest = max(len(words), len(other)), min(len(words), len(other))
                    if longest and 200 * shortest / (longest + shortest) < top + 0.5:
                        continue
                    score = indel_percent(words, other)
                    if score > top:
                        top, top_name = score, other_name
                if top_name is not None:
                    found.append((name, top_name, top))
            yield pd.DataFrame(found, columns=["left_name", "right_name", "score"])

    # scoring is slow per name, so names are dealt out to all cores
    return open_names.repartition(open_names.sparkSession.sparkContext.defaultParallelism).mapInPandas(best, BEST)


def _against_table(open_names: DataFrame, wordings: DataFrame, threshold: int) -> DataFrame:
    """Level by level from the most similar down; names found at a level need no further search.

    A level finds every pair that reaches it, so the best pair found there is the best of all. Where nothing is left over, the
    signatures of the right side aren't made for the levels below.
    """
    rights = cut(wordings)
    lefts = cut(open_names.select("words").distinct())
    letters = _letter_ranks(lefts.unionByName(rights.select("words")))
    ranked_left, ranked_right = cut(_ranked_letters(lefts, letters)), cut(_ranked_letters(rights.select("words"), letters))
    equal = lefts.join(rights, "words").select("words", F.col("name").alias("right_name"), F.lit(100).alias("score"))
    found = cut(equal)
    for level in [n for n in LEVELS if n > threshold] + [threshold]:
        still_open = ranked_left.join(found, "words", "left_anti")
        if still_open.isEmpty():
            break
        found = found.unionByName(cut(_reaching(still_open, ranked_right, rights, level)))
    return open_names.join(found, "words").select(F.col("name").alias("left_name"), "right_name", "score")


def _letters(words: Column) -> Column:
    """Each character with its running number: two texts share as many of these as they share characters."""
    chars = F.split(words, "")
    return F.transform(chars, lambda c, i: F.concat(c, (F.size(F.filter(F.slice(chars, 1, i + 1), lambda x: x == c))).cast("string")))


def _letter_ranks(words: DataFrame) -> DataFrame:
    """``(letter, rank)``: the rarest has the lowest number. Different letters are few, however many texts there are."""
    seen = words.select(F.explode(_letters(F.col("words"))).alias("letter"))
    uses = seen.groupBy("letter").agg(F.count(F.lit(1)).alias("uses"))
    return uses.select("letter", F.row_number().over(Window.orderBy("uses", "letter")).alias("rank"))


def _ranked_letters(words: DataFrame, letters: DataFrame) -> DataFrame:
    """``(words, size, ranked)``: the ranks of each text's letters, rarest first. A list is as long as its text."""
    each = words.select("words", F.explode(_letters(F.col("words"))).alias("letter"))
    listed = each.join(letters, "letter").groupBy("words").agg(F.array_sort(F.collect_list("rank")).alias("ranked"))
    return listed.select("words", F.length("words").alias("size"), "ranked")


def _letters_in_common(needed: str, level: int) -> str:
    """SQL: how many letters a signature has, from the number of common letters that a pair needs."""
    sizes = SIGNATURE_SIZES[min(LEVELS, key=lambda n: abs(n - level))]
    return "CASE " + " ".join(f"WHEN {needed} >= {least} THEN {size}" for least, size in sizes) + " END"


def _signatures(ranked: DataFrame, level: int) -> DataFrame:
    """``(words, size, ranked, l, prefix_size, signature)``: sets of rare letters of which two texts reaching the level share at least one.

    Reaching share t of ``2*LCS/(la+lb)`` needs at least ``t*la/(2-t)`` common characters, so common letters. Two texts
    that need k of them share l letters among the ``la - k + l`` rarest of each (prefix filtering), for any l up to k. A
    text does not know k, only its range, and gives the sets of every l that belongs to it.
    """
    t = (level - 0.5) / 100
    need = f"greatest(1, CAST(ceil(size * {t!r}D / (2 - {t!r}D) - 1e-9D) AS INT))"
    # All sets of l places, each set rising: one more place in every step.
    sets = (
        "aggregate(sequence(1, l), array(CAST(array() AS ARRAY<INT>)), (sets, step) -> flatten(transform(sets, s -> transform("
        "sequence(if(step = 1, 1, element_at(s, -1) + 1), prefix_size - l + step), i -> concat(s, array(i))))))"
    )
    sized = ranked.withColumn("need", F.expr(need)).where("need <= size")
    kinds = sized.withColumn("l", F.explode(F.expr(f"array_distinct(transform(sequence(need, size), k -> {_letters_in_common('k', level)}))")))
    chosen = kinds.withColumn("prefix_size", F.expr("size - need + l")).withColumn("chosen", F.explode(F.expr(sets)))
    return chosen.select("words", "size", "ranked", "l", "prefix_size", F.expr("transform(chosen, i -> ranked[i - 1]) AS signature"))


def _candidates(lefts: DataFrame, rights: DataFrame, level: int, pairs_in_task: int = PAIRS_IN_TASK) -> DataFrame:
    """``(words, other)``: every pair that may reach the level, exactly once.

    Two texts that share one signature share many. A pair is emitted where the signature is its first: the l rarest letters that
    both prefixes hold, with the l of the pair's own number of needed letters. The join also holds what the places of these letters
    and all letters of both texts allow. Signatures with much work, by counts of both sides, are cut into parts. A text has many
    signatures, which Spark's estimates don't know, so these joins are never made by sending one side to all tasks.
    """
    t = (level - 0.5) / 100
    left, right = _signatures(lefts, level), _signatures(rights, level)
    right = right.select(*[F.col(c).alias(c if c == "signature" else f"other_{c}") for c in right.columns])
    work = left.groupBy("signature", "l").agg(F.count(F.lit(1)).alias("n")).join(
        right.groupBy("signature", F.col("other_l").alias("l")).agg(F.count(F.lit(1)).alias("m")).hint("merge"), ["signature", "l"])
    heavy = cut(work.where(F.col("n") * F.col("m") > pairs_in_task).select(
        F.col("signature").alias("heavy"), F.col("l").alias("heavy_l"), F.least("n", F.ceil(F.col("n") * F.col("m") / pairs_in_task)).cast("int").alias("parts")))
    one = F.coalesce("parts", F.lit(1))
    left = left.join(heavy, (F.col("signature") == F.col("heavy")) & (F.col("l") == F.col("heavy_l")), "left").withColumn(
        "part", F.pmod(F.xxhash64("words"), one).cast("int"))
    right = right.join(heavy, (F.col("signature") == F.col("heavy")) & (F.col("other_l") == F.col("heavy_l")), "left").withColumn(
        "part", F.explode(F.sequence(F.lit(0), one - 1)))
    left = left.select(*[F.col(c).alias(c) for c in ("words", "size", "ranked", "l", "prefix_size", "signature", "part")])
    right = right.select(*[F.col(c).alias(c) for c in ("other_words", "other_size", "other_ranked", "other_l", "other_prefix_size", "signature", "part")])
    needed = f"greatest(1, CAST(ceil((size + other_size) * {t!r}D / 2 - 1e-9D) AS INT))"
    letter = "element_at(signature, -1)"
    first_shared = "slice(array_intersect(slice(ranked, 1, prefix_size), slice(other_ranked, 1, other_prefix_size)), 1, l) = signature"
    places = f"l + least(size - array_position(ranked, {letter}), other_size - array_position(other_ranked, {letter})) >= {needed}"
    kept = (
        (F.col("l") == F.col("other_l")) & F.expr(f"least(size, other_size) >= {needed}")
        & F.expr(f"l = {_letters_in_common(needed, level)}") & F.expr(places) & F.expr(first_shared)
        & F.expr(f"size(array_intersect(ranked, other_ranked)) >= {needed}")
    )
    met = left.join(right.hint("merge"), ["signature", "part"])
    return met.where(kept).select("words", F.col("other_words").alias("other"))


def _reaching(lefts: DataFrame, ranked_right: DataFrame, rights: DataFrame, level: int) -> DataFrame:
    """The best right wording of each left wording among all that reach the level."""
    def scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            score = indel_percents(list(batch["words"]), list(batch["other"]))
            yield batch.assign(score=score)[score >= level]

    scored = _candidates(lefts, ranked_right, level).mapInPandas(scores, "words string, other string, score int")
    named = scored.join(rights.select(F.col("words").alias("other"), "name", "place"), "other")
    first = F.min_by(F.struct("name", "score"), F.struct(-F.col("score"), F.col("place"), F.col("name")))
    return named.groupBy("words").agg(first.alias("best")).select(
        "words", F.col("best.name").alias("right_name"), F.col("best.score").alias("score")
    )


def hybrid_match(left: DataFrame, right: DataFrame, cosine_best: DataFrame) -> DataFrame:
    """``(left_name, right_name, score)``: names first (85 or better), then vectors for lefts left over.

    ``cosine_best`` is ``(left_name, right_name, cosine)`` for all lefts, as from ``best_cosine_match``. A right
    taken by name is not given away; rivals for another right are settled by the higher cosine.
    """
    by_name = cut(_one_left_per_right(best_right_per_left(left, right, FIRST_STAGE), left))
    free = cosine_best.join(by_name.select("left_name"), "left_name", "left_anti").join(
        by_name.select("right_name"), "right_name", "left_anti"
    )
    places = left.select(F.col("name").alias("left_name"), "place")
    first = F.min_by(F.struct("left_name", "cosine"), F.struct(-F.col("cosine"), F.col("place"), F.col("left_name")))
    by_vector = free.join(places, "left_name").groupBy("right_name").agg(first.alias("kept"))
    return by_name.select("left_name", "right_name", F.col("score").cast("double").alias("score")).unionByName(
        by_vector.select(F.col("kept.left_name").alias("left_name"), "right_name", F.col("kept.cosine").alias("score"))
    )
