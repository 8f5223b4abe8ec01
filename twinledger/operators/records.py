"""Record comparison and any-of comparison: one row per differing cell or missing row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import ATOL, RTOL, as_number, numbers_differ, texts_differ, with_parsed
from ..functions.similarity import reaches, similarity, similarity_bound, token_sorted
from ..functions.text import ident, is_missing, is_numeric, literal, normal_text, quoted, render, stripped, type_of
from ..spec import MISSING_KEY, MISSING_ROW, Pair, Rule, check_columns, key_pairs, rules_from
from .coercion import Modes, column_pairs, pair_types
from .keys import FOUND_IN, KEY_PARTS, KeyPlan, key_overview, key_rows
from .survey import Survey, modes_only, take_survey

# Rows of a hot key that a part of one side stands for; every part of A meets every part of B on its own.
PART_ROWS = 10_000
# Repeated rows are written out in runs of at most this many.
REPEAT_RUN = 10_000
# Hot keys up to this many go to every task, more are joined.
BROADCAST_KEYS = 100_000

# Rows that a counted mismatch stands for: two large counts multiplied do not fit a BIGINT.
COUNT_TYPE = "decimal(38,0)"

COLUMNS = ["key_df1", "key_df2", "col_df1", "col_df2", "val_df1", "val_df2"]
HEAD = [KEY_PARTS, FOUND_IN, "key_df1", "key_df2"]


@dataclass(frozen=True)
class Labels:
    """What the last column of the mismatch table says."""

    column: str
    missing_in_b: str
    missing_in_a: str


RECORD_LABELS = Labels("match_type", "Missing in Source B", "Missing in Source A")
ANY_OF_LABELS = Labels("comparison_type", "missing_key", "missing_key")
# Rules of several mappings in one comparison: findings carry the rule's number (column RULE; -1 for rows without partner).
SHARED_LABELS = Labels("kind", "Missing in Source B", "Missing in Source A")
RULE, NO_RULE = "rule", -1


@dataclass
class Comparison:
    """Result of a comparison: the mismatch table, and what was found about keys and types before it."""

    findings: DataFrame
    rules: list[Rule]
    plan: KeyPlan
    survey: Survey
    sources: tuple[DataFrame, DataFrame]

    @property
    def mismatches(self) -> DataFrame:
        """The findings as they are shown; scores and look-ups use ``findings``, which also hold the key itself."""
        return self.findings.drop(KEY_PARTS, FOUND_IN)

    @property
    def overview(self) -> DataFrame:
        """One row of key and row counts: from the survey if one was taken, else counted when used."""
        if self.survey.overview:
            return self.findings.sparkSession.createDataFrame([self.survey.overview])
        return key_overview(key_rows(*self.sources, self.plan))

    @property
    def coercion(self) -> DataFrame:
        """How each pair was handled: value shares over the matched rows, mode and note."""
        if self.survey.types is not None:
            return self.survey.types
        return pair_types(*self.sources, column_pairs(self.rules), self.plan)


def compare_records(a: DataFrame, b: DataFrame, keys, columns, **options) -> Comparison:
    """Compare column pairs record by record on single or composite keys.

    ``columns`` is ``{a: b}`` or a list of ``Pair``. See ``compare`` for the options.
    """
    return compare(a, b, keys, columns, RECORD_LABELS, **options)


def compare_any_of(a: DataFrame, b: DataFrame, keys, columns, **options) -> Comparison:
    """As ``compare_records``, but a value of A passes if it equals ANY of its target columns.

    ``columns`` is ``{a: [b1, b2]}`` or a list of ``AnyOf``. A failing value gives one row per target.
    """
    return compare(a, b, keys, columns, ANY_OF_LABELS, **options)


def compare(
    a: DataFrame,
    b: DataFrame,
    keys,
    columns,
    labels: Labels,
    *,
    case_sensitive: bool = False,
    null_keys: str = "match",
    modes: Mapping | None = None,
    skew: str = "auto",
    rtol: float = RTOL,
    atol: float = ATOL,
    counted: bool = False,
    hot_rows: int | None = None,
    hot_pairs: int | None = None,
) -> Comparison:
    """Join on normalised keys and report every differing cell and every row without partner.

    Duplicate keys are matched many to many. With ``counted`` equal mismatch rows are not repeated: column
    ``n_rows`` says how often each occurs.

    ``skew="auto"`` counts the keys first and treats keys with very many rows apart; ``skew="none"`` with
    ``modes`` for all text pairs gives a single lazy plan.
    """
    pairs_of_keys = key_pairs(keys)
    rules = rules_from(columns)
    check_columns(a, b, pairs_of_keys, rules, once=labels is not SHARED_LABELS)
    plan = KeyPlan.of(a, b, pairs_of_keys, case_sensitive, null_keys)
    pairs = list(dict.fromkeys(column_pairs(rules)))
    if skew == "auto":
        limits = {k: v for k, v in (("hot_rows", hot_rows), ("hot_pairs", hot_pairs)) if v is not None}
        survey = take_survey(a, b, plan, pairs, modes, **limits)
    elif skew == "none":
        open_pairs = [p for p in pairs if p not in (modes or {})]
        survey = Survey({**modes_only(a, b, plan, open_pairs), **dict(modes or {})})
    else:
        raise ValueError("skew is 'auto' or 'none'")

    engine = _Engine(a, b, plan, rules, survey.modes, labels, rtol, atol)
    if survey.hot is None:
        found = engine.by_full_join(a, b)
        if counted:
            found = found.withColumn("n_rows", _once())
    else:
        found = engine.with_hot_keys(survey.hot, counted)
    if counted:
        shown = [KEY_PARTS, FOUND_IN, *COLUMNS, labels.column, *([RULE] if labels is SHARED_LABELS else [])]
        found = found.groupBy(*shown).agg(F.sum("n_rows").cast(COUNT_TYPE).alias("n_rows"))
    return Comparison(found, rules, plan, survey, (a, b))


class _Engine:
    """Builds the plans of one comparison; holds no data."""

    def __init__(self, a, b, plan: KeyPlan, rules: Sequence[Rule], modes: Modes, labels: Labels, rtol: float, atol: float):
        self.a, self.b, self.plan, self.rules, self.modes, self.labels = a, b, plan, rules, modes, labels
        self.rtol, self.atol = rtol, atol

    # -- plan 1: one full outer join on the keys ------------------------------------------------

    def by_full_join(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """All rules in one pass over one join: rows without a finding go before anything is built for them."""
        numbers = range(len(self.rules))
        slim_a = self.plan.slim(a, "a", [F.expr(f"{ident(r.a)} AS a{i}") for i, r in enumerate(self.rules)])
        slim_b = self.plan.slim(b, "b", [F.expr(f"{ident(t)} AS b{i}_{j}") for i, r in enumerate(self.rules) for j, t in enumerate(r.targets)])
        slim_a = with_parsed(slim_a, self._texts_to_parse_a()).withColumn("in_a", F.lit(True))
        slim_b = with_parsed(slim_b, self._texts_to_parse_b()).withColumn("in_b", F.lit(True))
        joined = slim_a.join(slim_b, self.plan.names, "full_outer")
        lone = "(in_a IS NULL OR in_b IS NULL)"
        failed = [self._failed(i) for i in numbers]
        cells = [
            f"CASE WHEN {failed[i]} THEN {self._cell(i, j, f'a{i}', f'b{i}_{j}')} END"
            for i in numbers
            for j in range(len(self.rules[i].targets))
        ]
        findings = f"array({self._absent_row('in_a IS NULL')})"
        if cells:
            findings = f"CASE WHEN {lone} THEN {findings} ELSE array({', '.join(cells)}) END"
        rows = joined.where(" OR ".join([lone, *(f"({f})" for f in failed)])).select(
            self.plan.parts.alias(KEY_PARTS),
            F.expr(f"CASE WHEN in_a IS NULL THEN 'b' WHEN in_b IS NULL THEN 'a' ELSE 'both' END AS {FOUND_IN}"),
            F.when(F.expr("in_a IS NULL"), MISSING_KEY).otherwise(self.plan.display).alias("key_df1"),
            F.when(F.expr("in_b IS NULL"), MISSING_KEY).otherwise(self.plan.display).alias("key_df2"),
            F.expr(f"explode({findings}) AS cell"),
        )
        return self._scored(rows.where("cell IS NOT NULL")).selectExpr(*HEAD, *self._output())

    def _numeric(self, i: int, j: int) -> bool:
        return self.modes[(self.rules[i].a, self.rules[i].targets[j])] == "numeric"

    def _type_a(self, i: int) -> T.DataType:
        return type_of(self.a, self.rules[i].a)

    def _type_b(self, i: int, j: int) -> T.DataType:
        return type_of(self.b, self.rules[i].targets[j])

    def _texts_to_parse_a(self) -> dict[str, str]:
        """Text columns compared as numbers are parsed once per row, before the join multiplies rows."""
        return {
            f"a{i}_number": stripped(f"a{i}", self._type_a(i))
            for i, rule in enumerate(self.rules)
            if not is_numeric(self._type_a(i)) and any(self._numeric(i, j) for j in range(len(rule.targets)))
        }

    def _texts_to_parse_b(self) -> dict[str, str]:
        return {
            f"b{i}_{j}_number": stripped(f"b{i}_{j}", self._type_b(i, j))
            for i, rule in enumerate(self.rules)
            for j in range(len(rule.targets))
            if not is_numeric(self._type_b(i, j)) and self._numeric(i, j)
        }

    def _failed(self, i: int) -> str:
        """True where no target of rule i equals the source value."""
        tests = []
        type_a, a = self._type_a(i), f"a{i}"
        for j in range(len(self.rules[i].targets)):
            type_b, b = self._type_b(i, j), f"b{i}_{j}"
            if self._numeric(i, j):
                number_a = as_number(a, type_a) if is_numeric(type_a) else f"{a}_number"
                number_b = as_number(b, type_b) if is_numeric(type_b) else f"{b}_number"
                tests.append(numbers_differ(number_a, number_b, self.rtol, self.atol))
            else:
                differ = texts_differ(normal_text(a, type_a), normal_text(b, type_b))
                # equal as they are: no need to normalise
                same = f"{a} <=> {b}" if type_a == type_b == T.StringType() else "false"
                tests.append(f"NOT ({same}) AND {differ}")
        return " AND ".join(f"({t})" for t in tests)

    def _is_fuzzy(self, i: int) -> bool:
        return self.rules[i].threshold < 100 and not self._numeric(i, 0)

    def _cell(self, i: int, j: int, a: str, b: str) -> str:
        type_a, type_b = self._type_a(i), self._type_b(i, j)
        fuzzy = self._fuzzy_fields(i, normal_text(a, type_a), normal_text(b, type_b))
        missing = f"{is_missing(a, type_a)} OR {is_missing(b, type_b)}"
        return self._struct(i, j, render(a, type_a), render(b, type_b), missing, fuzzy)

    def _struct(self, i: int, j: int, shown_a: str, shown_b: str, missing: str, fuzzy: str) -> str:
        source, target = self.rules[i].a, self.rules[i].targets[j]
        label = literal(f"{source} vs {target}")
        if self.labels is RECORD_LABELS or self._shared and isinstance(self.rules[i], Pair):
            label = f"if({missing}, 'Missing Value', 'Value Mismatch')"
        return (
            f"named_struct('col_df1', {literal(source)}, 'col_df2', {literal(target)}, 'val_df1', {shown_a}, "
            f"'val_df2', {shown_b}, 'label', {label}{self._rule_field(i)}{fuzzy})"
        )

    def _absent_row(self, not_in_a: str) -> str:
        cells = ", ".join(f"'{n}', '{MISSING_ROW}'" for n in COLUMNS[2:])
        label = f"if({not_in_a}, '{self.labels.missing_in_a}', '{self.labels.missing_in_b}')"
        return f"named_struct({cells}, 'label', {label}{self._rule_field(NO_RULE)}{self._no_scoring()})"

    @property
    def _shared(self) -> bool:
        return self.labels is SHARED_LABELS

    def _rule_field(self, i: int) -> str:
        return f", '{RULE}', {i}" if self._shared else ""

    # -- similar texts: only cells that differ and might still pass are scored -------------------

    def _any_fuzzy(self) -> bool:
        return any(self._is_fuzzy(i) for i in range(len(self.rules)))

    def _no_scoring(self) -> str:
        nothing = "CAST(NULL AS STRING)"
        return f", 'text_a', {nothing}, 'text_b', {nothing}, 'threshold', 100" if self._any_fuzzy() else ""

    def _fuzzy_fields(self, i: int, a: str, b: str) -> str:
        if not self._is_fuzzy(i):
            return self._no_scoring()
        words_a, words_b, threshold = token_sorted(a), token_sorted(b), self.rules[i].threshold
        # 0.5 below the threshold still rounds up to it
        bound = f"coalesce({similarity_bound(words_a, words_b)} >= {threshold - 0.5}D, true)"
        wordless = f"length({words_a}) + length({words_b}) = 0"
        possible = f"{a} <> '' AND {b} <> '' AND ({wordless} OR {bound})"
        return f", 'text_a', if({possible}, {words_a}, NULL), 'text_b', if({possible}, {words_b}, NULL), 'threshold', {threshold}"

    def _scored(self, rows: DataFrame) -> DataFrame:
        if not self._any_fuzzy():
            return rows
        open_cells = self.open_cells(rows)
        text = lambda side: F.expr(f"if(reached IS NULL, cell.text_{side}, NULL)")
        scored = open_cells.withColumn("score", similarity(text("a"), text("b")))
        return scored.where("NOT coalesce(score >= cell.threshold, false)").drop("score", "reached")

    @staticmethod
    def open_cells(rows: DataFrame) -> DataFrame:
        """The rows without the cells that pass by their edit distance; ``reached`` is null where only a score can tell."""
        judged = rows.withColumn("reached", F.expr(
            f"if(cell.text_a IS NULL OR cell.text_b IS NULL, false, {reaches('cell.text_a', 'cell.text_b', 'cell.threshold')})"))
        return judged.where("reached IS NULL OR NOT reached")

    def _output(self) -> list[str]:
        rule = [f"cell.{RULE} AS {RULE}"] if self._shared else []
        return [f"cell.{n} AS {n}" for n in COLUMNS[2:]] + [f"cell.label AS {self.labels.column}", *rule]

    # -- plan 2: keys with very many rows apart --------------------------------------------------

    def with_hot_keys(self, hot: DataFrame, counted: bool) -> DataFrame:
        """Full join for ordinary keys; hot keys by their distinct values, cut into parts.

        ``hot`` holds the keys with their counts; it goes to every task if it is short, and is joined by key if not.
        """
        if hot.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
            hot = F.broadcast(hot)
        keys = hot.select(*self.plan.names)
        keyed_a = self.plan.slim(self.a, "a", [quoted(c) for c in self.a.columns])
        keyed_b = self.plan.slim(self.b, "b", [quoted(c) for c in self.b.columns])
        names = self.plan.names
        cold = self.by_full_join(
            keyed_a.join(keys, names, "left_anti").drop(*names), keyed_b.join(keys, names, "left_anti").drop(*names)
        )
        parts = [self._hot_lone(keyed_a, hot, "n_b", in_a=True), self._hot_lone(keyed_b, hot, "n_a", in_a=False)]
        if self.rules:
            parts.append(self._hot_cells(keyed_a, keyed_b, hot, counted))
        if counted:
            cold = cold.withColumn("n_rows", _once())
            parts[:2] = [p.withColumn("n_rows", _once()) for p in parts[:2]]
        for part in parts:
            cold = cold.unionByName(part)
        return cold

    def _hot_lone(self, keyed: DataFrame, hot: DataFrame, other_count: str, in_a: bool) -> DataFrame:
        """Rows of hot keys that the other side does not have at all."""
        alone = hot.where(f"{other_count} = 0").select(*self.plan.names)
        rows = keyed.join(alone, self.plan.names, "left_semi").select(
            self.plan.parts.alias(KEY_PARTS), F.lit("a" if in_a else "b").alias(FOUND_IN),
            (self.plan.display if in_a else F.lit(MISSING_KEY)).alias("key_df1"),
            (F.lit(MISSING_KEY) if in_a else self.plan.display).alias("key_df2"),
            F.expr(f"{self._absent_row('false' if in_a else 'true')} AS cell"),
        )
        return rows.selectExpr(*HEAD, *self._output())

    def _hot_cells(self, keyed_a: DataFrame, keyed_b: DataFrame, hot: DataFrame, counted: bool) -> DataFrame:
        """Compare the distinct values of each rule within a hot key, and count what they stand for."""
        names, numbers = self.plan.names, range(len(self.rules))
        sources = f"inline(array({', '.join(self._source_struct(i) for i in numbers)}))"
        targets = f"inline(array({', '.join(self._target_struct(i) for i in numbers)}))"
        # The parts of a key follow its rows on either side.
        cut = ["parts_a", "parts_b"]
        keys = hot.where("n_a > 0 AND n_b > 0").selectExpr(*names, *[f"(n_{x} + {PART_ROWS - 1}) DIV {PART_ROWS} AS parts_{x}" for x in "ab"])
        side_a = keyed_a.join(keys, names, "inner").selectExpr(*names, *cut, sources)
        side_b = keyed_b.join(keys, names, "inner").selectExpr(*names, *cut, targets)
        values_a = side_a.groupBy(*names, *cut, "rule", "raw_a", "text_a", "num_a").agg(F.count(F.lit(1)).alias("n_a"))
        values_b = side_b.groupBy(*names, *cut, "rule", "raw_b", "text_b", "num_b").agg(F.count(F.lit(1)).alias("n_b"))

        cut_a = values_a.selectExpr("*", "pmod(xxhash64(raw_a), parts_a) AS part_a", "explode(sequence(0L, parts_b - 1)) AS part_b").drop(*cut)
        cut_b = values_b.selectExpr("*", "pmod(xxhash64(raw_b), parts_b) AS part_b", "explode(sequence(0L, parts_a - 1)) AS part_a").drop(*cut)
        met = cut_a.join(cut_b, [*names, "rule", "part_a", "part_b"], "inner")

        failed = " ".join(f"WHEN rule = {i} THEN {self._hot_failed(i)}" for i in numbers)
        cells = " ".join(
            f"WHEN rule = {i} THEN array({', '.join(self._hot_cell(i, j) for j in range(len(self.rules[i].targets)))})"
            for i in numbers
        )
        rows = met.where(f"CASE {failed} END").select(
            self.plan.parts.alias(KEY_PARTS), F.lit("both").alias(FOUND_IN),
            self.plan.display.alias("key_df1"), self.plan.display.alias("key_df2"), "n_a", "n_b",
            F.expr(f"explode(CASE {cells} END) AS cell"),
        )
        rows = self._scored(rows)
        if counted:
            product = f"CAST(CAST(n_a AS DECIMAL(18,0)) * CAST(n_b AS DECIMAL(18,0)) AS {COUNT_TYPE}) AS n_rows"
            return rows.selectExpr(*HEAD, *self._output(), product)
        repeated = rows
        for n in ("n_a", "n_b"):
            # In runs, so that no row ever holds an array as long as the count.
            repeated = repeated.withColumn("run", F.expr(f"explode(sequence(0L, ({n} - 1) DIV {REPEAT_RUN}))"))
            repeated = repeated.withColumn("again", F.expr(f"explode(sequence(1L, least({REPEAT_RUN}L, {n} - run * {REPEAT_RUN})))"))
        return repeated.selectExpr(*HEAD, *self._output())

    def _source_struct(self, i: int) -> str:
        x, dtype = ident(self.rules[i].a), self._type_a(i)
        numeric = [self._numeric(i, j) for j in range(len(self.rules[i].targets))]
        text = "CAST(NULL AS STRING)" if all(numeric) else normal_text(x, dtype)
        number = as_number(x, dtype) if any(numeric) else "CAST(NULL AS DOUBLE)"
        return f"named_struct('rule', {i}, 'raw_a', {render(x, dtype)}, 'text_a', {text}, 'num_a', {number})"

    def _target_struct(self, i: int) -> str:
        raws, texts, numbers = [], [], []
        for j, target in enumerate(self.rules[i].targets):
            x, dtype = ident(target), self._type_b(i, j)
            raws.append(render(x, dtype))
            texts.append("CAST(NULL AS STRING)" if self._numeric(i, j) else normal_text(x, dtype))
            numbers.append(as_number(x, dtype) if self._numeric(i, j) else "CAST(NULL AS DOUBLE)")
        lists = [f"array({', '.join(items)})" for items in (raws, texts, numbers)]
        return f"named_struct('rule', {i}, 'raw_b', {lists[0]}, 'text_b', {lists[1]}, 'num_b', {lists[2]})"

    def _hot_failed(self, i: int) -> str:
        tests = [
            numbers_differ("num_a", f"num_b[{j}]", self.rtol, self.atol) if self._numeric(i, j)
            else texts_differ("text_a", f"text_b[{j}]")
            for j in range(len(self.rules[i].targets))
        ]
        return " AND ".join(f"({t})" for t in tests)

    def _hot_cell(self, i: int, j: int) -> str:
        fuzzy = self._fuzzy_fields(i, "text_a", f"text_b[{j}]")
        return self._struct(i, j, "raw_a", f"raw_b[{j}]", f"raw_a IS NULL OR raw_b[{j}] IS NULL", fuzzy)


def _once() -> Column:
    return F.lit(1).cast(COUNT_TYPE)


def outer_rows(a: DataFrame, b: DataFrame, keys, columns_a: Sequence[str], columns_b: Sequence[str], **key_options) -> DataFrame:
    """All rows of both sides joined on their keys, with ``found_in`` saying ``both``, ``a`` or ``b``."""
    joined = _joined(a, b, keys, columns_a, columns_b, "full_outer", key_options)
    return joined.selectExpr("*", "CASE WHEN in_b IS NULL THEN 'a' WHEN in_a IS NULL THEN 'b' ELSE 'both' END AS found_in").drop("in_a", "in_b")


def matched_rows(a: DataFrame, b: DataFrame, keys, columns_a: Sequence[str], columns_b: Sequence[str], **key_options) -> DataFrame:
    """Rows found on both sides, with the wanted columns (B's get the suffix ``_b`` where the names clash)."""
    return _joined(a, b, keys, columns_a, columns_b, "inner", key_options).drop("in_a", "in_b")


def _joined(a: DataFrame, b: DataFrame, keys, columns_a, columns_b, how: str, key_options: dict) -> DataFrame:
    plan = KeyPlan.of(a, b, key_pairs(keys), **key_options)
    slim_a = plan.slim(a, "a", [quoted(c) for c in columns_a] + [F.lit(True).alias("in_a")])
    slim_b = plan.slim(
        b, "b", [quoted(c).alias(f"{c}_b" if c in columns_a else c) for c in columns_b] + [F.lit(True).alias("in_b")]
    )
    joined = slim_a.join(slim_b, plan.names, how)
    return joined.select(plan.display.alias("row_key"), *[quoted(c) for c in joined.columns if c not in plan.names])


def missing_rows(a: DataFrame, b: DataFrame, keys, missing_in: str = "b", **key_options) -> DataFrame:
    """Keys of rows of one side that the other side does not have, one row per source row.

    An anti join against the other side's distinct keys: AQE may split a key with many rows on the kept side.
    """
    plan = KeyPlan.of(a, b, key_pairs(keys), **key_options)
    kept, other = plan.slim(a, "a"), plan.slim(b, "b")
    if missing_in == "a":
        kept, other = other, kept
    lone = kept.join(other.distinct(), plan.names, "left_anti")
    return lone.select(plan.display.alias("row_key"))
