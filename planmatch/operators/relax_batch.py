"""Constraint relaxation for a whole table of requests, without pairing requests
with catalog rows.

Requests and catalog both grow, so their product is never formed. Instead

1. the constants of the requests cut every numeric column into cells; whether a
   row meets a condition depends on its cell only, so the catalog collapses to
   its distinct cells with the best few rows of each;
2. a cell is listed under every tree node that contains it (`functions.covers`)
   and under "any" for each column, and again only the best rows are kept per
   key - trimmed before the shuffle, so a hot key costs nothing;
3. identical requests are handled once. For each number of dropped labels the
   remaining conditions form a probe, and identical probes are handled once;
4. a probe becomes a short list of node keys and finds its rows by equi-join.

Work is (cells + probes) x a power of the logarithm of the number of constants. The power
is the number of numeric columns constrained together; beyond LISTED_AXES of them cells are
not listed, and probes travel in weighed blocks to the cells, which are indexed in price
order (`operators.cell_index`), with equal results.

Constants are compared as doubles where that is exact, and otherwise by their position among
the values of the column's own type: long, decimal, date, timestamp or text.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from math import inf, nextafter

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planmatch.functions.covers import ancestors, depth_for, interval_cover, leaf
from planmatch.functions.predicates import OPS, named, normalise_category
from planmatch.operators.cell_index import first_rows, probe_of
from planmatch.operators.close_match import expand_close
from planmatch.operators.joins import join_back
from planmatch.operators.ranking import value_positions
from planmatch.sources.storage import explosion_tasks, materialise

# Distinct constants per column that may be held as literals.
INLINE_CONSTANTS = 4096

# Numeric columns constrained together up to which cells are always listed under nodes.
LISTED_AXES = 2
# Text of probes that travels with one pass over the cells.
PROBE_BYTES = 16_000_000
# Whole numbers below this are exact as doubles.
EXACT = 1 << 53

MAX_DOUBLE = sys.float_info.max


@dataclass
class _Axis:
    """One constrained catalog column."""

    index: int
    name: str
    numeric: bool  # has an order that conditions use; cells are numbers then
    ops: set[str]
    depth: int = 0
    own: T.DataType | None = None  # compared in this type instead of as doubles

    @property
    def key(self) -> str:
        return f"k{self.index}"

    @property
    def parity(self) -> int | None:
        """All bounds from above need even nodes only, all from below odd ones only."""
        if self.ops <= {"<=", "<"}:
            return 0
        if self.ops <= {">=", ">"}:
            return 1
        return None


NUMBER_OPS = frozenset({"=", "in", "between", "<", "<=", ">", ">="})
TEXT_OPS = frozenset({"=", "in", "~"})
RANGE_OPS = frozenset({"between", "<", "<=", ">", ">="})
TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def rank_relevance(relevance: DataFrame) -> DataFrame:
    """Rank 1 is the least relevant label of a request; ties by label."""
    order = Window.partitionBy("request_id").orderBy("score", "col")
    return relevance.withColumn("rk", F.row_number().over(order))


def split_requests(
    constraints: DataFrame,
    catalog_columns: Sequence[str],
    schema: T.StructType | None = None,
    text_ranges: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Constraints of well-formed requests, and one error row per other request. With the
    catalog's `schema` that includes operators that a column's type does not have, values
    that cannot be read in that type, and `between` without two values. Ranges on text are
    taken with `text_ranges`."""
    problem = F.when(
        ~F.col("col").isin(list(catalog_columns)),
        F.concat(F.lit("unknown column: "), "col"),
    ).when(~F.col("op").isin(list(OPS)), F.concat(F.lit("unknown operator: "), "op"))
    if schema is not None:
        ordered = [f for f in schema.fields if isinstance(f.dataType, (T.NumericType, *TIMES))]
        of_text = sorted(OPS) if text_ranges else list(TEXT_OPS)
        allowed = F.when(
            F.col("col").isin([f.name for f in ordered]), F.col("op").isin(list(NUMBER_OPS))
        ).otherwise(F.col("op").isin(of_text))
        problem = problem.when(~allowed, F.concat("op", F.lit(" does not suit column: "), "col"))
        problem = problem.when(
            (F.col("op") == "between") & (F.coalesce(F.size("values"), F.lit(0)) != 2),
            F.concat(F.lit("between needs two values: "), "col"),
        )
        for field in ordered:
            kind = field.dataType if isinstance(field.dataType, TIMES) else T.DoubleType()
            unread = F.exists("values", lambda v: v.isNotNull() & v.try_cast(kind).isNull())
            problem = problem.when(
                (F.col("col") == field.name) & unread, F.concat(F.lit("unreadable value for column: "), "col")
            )
    checked = constraints.withColumn("_problem", problem)
    errors = (
        checked.where(F.col("_problem").isNotNull())
        .groupBy("request_id")
        .agg(F.min("_problem").alias("error"))
    )
    return constraints.join(errors, "request_id", "left_anti"), errors


def drop_conditions(constraints: DataFrame, dropped: DataFrame) -> DataFrame:
    """Remove every condition on a dropped (request_id, col)."""
    return constraints.join(dropped, ["request_id", "col"], "left_anti")


def render_queries(constraints: DataFrame) -> DataFrame:
    """Conditions of each request as text, in their order."""
    col, values = F.col("col"), F.col("values")
    first = F.get(values, F.lit(0))
    text = (
        F.when(
            F.col("op") == "between",
            F.concat(col, F.lit(" between "), first, F.lit(" and "), F.get(values, F.lit(1))),
        )
        .when(
            F.col("op") == "in",
            F.concat(col, F.lit(" in ("), F.concat_ws(", ", values), F.lit(")")),
        )
        .otherwise(F.concat_ws(" ", col, "op", first))
    )
    ordered = F.array_sort(F.collect_list(F.struct(F.col("ord"), text.alias("txt"))))
    return constraints.groupBy("request_id").agg(
        F.concat_ws(" AND ", F.transform(ordered, lambda c: c["txt"])).alias("query")
    )


def relax_batch(
    catalog: DataFrame,
    requests: DataFrame,
    constraints: DataFrame,
    relevance: DataFrame,
    *,
    key: str,
    price: str,
    payload: Sequence[str] = (),
    n: int = 3,
    folded: Sequence[str] = (),
    inline_constants: int = INLINE_CONSTANTS,
    broadcast_rows: int | None = None,
    probe_bytes: int = PROBE_BYTES,
) -> DataFrame:
    """Per request: `level` (labels given up), `n_labels`, and `rows`, the best `n`
    qualifying rows by price as array<struct(pos, price, key, payload...)>; `rows`
    is null when nothing qualifies even at the end.

    requests(request_id); constraints(request_id, ord, col, op, values
    array<string>) on catalog columns - set others aside with `split_requests`;
    relevance(request_id, col, score). `payload` travels with every kept row, so
    name few columns. Text columns named in `folded` are compared without regard to case,
    outer blanks and runs of blanks; answers show them as they are.
    """
    joins = {} if broadcast_rows is None else {"broadcast_rows": broadcast_rows}
    catalog, constraints = _fold(catalog, constraints, folded)
    asked = _prepare(catalog, requests, constraints, relevance, inline_constants, joins)
    axes, levels, probes, profiles = asked.axes, asked.levels, asked.probes, asked.profiles
    best_cells = _best_cells(asked.cells, axes, key, price, payload, n, folded)
    if asked.wide:
        hits = _walk(best_cells, probes, axes, n, probe_bytes)
    else:
        hits = _search(_node_rows(best_cells, asked.masks, axes, n), probes, axes, n)

    found = join_back(levels, hits, ["probe"], ["sig", "level"], **joins).groupBy("sig").agg(
        F.max("n_sig").alias("n"),
        F.min(F.when(F.col("rows").isNotNull(), F.col("level"))).alias("level"),
        F.min_by("rows", F.when(F.col("rows").isNotNull(), F.col("level"))).alias("rows"),
    )
    answers = join_back(profiles, found, ["sig"], ["request_id"], **joins)
    return answers.select(
        "request_id",
        F.coalesce("level", "n_labels").alias("level"),
        "n_labels",
        "rows",
    )


def relax_levels(
    catalog: DataFrame,
    requests: DataFrame,
    constraints: DataFrame,
    relevance: DataFrame,
    *,
    folded: Sequence[str] = (),
    inline_constants: int = INLINE_CONSTANTS,
    broadcast_rows: int | None = None,
    probe_bytes: int = PROBE_BYTES,
) -> DataFrame:
    """Per request `level`, `n_labels` and `is_empty`, as `relax_batch` finds them, without
    rows: a node says only that something lies under it. A column bounded from one side
    needs no nodes: what lies under a node is told by its least (or largest) value there.
    Of the catalog nothing but the distinct constrained values is read on; it
    needs neither key nor price. A request without conditions is empty only where the
    catalog is."""
    joins = {} if broadcast_rows is None else {"broadcast_rows": broadcast_rows}
    catalog, constraints = _fold(catalog, constraints, folded)
    asked = _prepare(catalog, requests, constraints, relevance, inline_constants, joins, bare=True)
    axes = asked.axes
    if asked.wide:
        sources = [f"c{a.index}" for a in axes]
        # Any order does where one cell is enough.
        bare = asked.cells.select(*sources).distinct().withColumns(
            {"_price": F.lit(0), "_key": F.xxhash64(*sources), "row": F.struct(F.lit(0).alias("some"))}
        )
        hits = _walk(bare, asked.probes, axes, 1, probe_bytes).select("probe", "n")
    else:
        hits = _met(asked)
    hits = hits.withColumn("hit", F.lit(True))
    found = join_back(asked.levels, hits, ["probe"], ["sig", "level"], **joins).groupBy("sig").agg(
        F.max("n_sig").alias("n"), F.min(F.when(F.col("hit"), F.col("level"))).alias("level")
    )
    return join_back(asked.profiles, found, ["sig"], ["request_id"], **joins).select(
        "request_id",
        F.coalesce("level", "n_labels").alias("level"),
        "n_labels",
        F.col("level").isNull().alias("is_empty"),
    )


@dataclass
class _Asked:
    """A table of requests in terms of cells."""

    axes: list[_Axis]
    cells: DataFrame
    profiles: DataFrame
    levels: DataFrame
    probes: DataFrame
    masks: list[int]

    @property
    def wide(self) -> bool:
        """Whether some probe constrains more numeric columns than cells are listed for."""
        return any(
            sum(a.numeric and m >> a.index & 1 for a in self.axes) > LISTED_AXES for m in self.masks
        )


def _met(asked: _Asked) -> DataFrame:
    """(probe, n) of the probes that some cell meets."""
    cells, axes = asked.cells, asked.axes
    if not axes:
        some = cells.limit(1).select(F.lit("{}").alias("probe"))
        return asked.probes.select("probe", "n").join(F.broadcast(some), "probe")
    one_sided = [a for a in axes if a.numeric and a.parity is not None]
    bound = max(one_sided, key=lambda a: a.depth, default=None)
    rest = [a for a in axes if a is not bound]
    if bound is None:
        best, end, good = F.lit(True), F.lit(True), F.lit(True)
        outermost = F.first
    else:
        best, wish = F.col(f"c{bound.index}"), F.col(f"w{bound.index}")
        upper = bound.parity == 0
        outermost = F.min if upper else F.max
        end = wish["hi"] if upper else wish["lo"]
        reached = F.col("best") <= F.col("end") if upper else F.col("best") >= F.col("end")
        good = F.col("end").isNull() | F.coalesce(reached, F.lit(False))
    sources = [f"c{a.index}" for a in rest]
    cells = cells.groupBy(*sources).agg(outermost(best).alias("best"), F.count(F.lit(1)).alias("_rows"))
    # Without other columns there is a group even where the catalog is empty.
    cells = cells.where(F.col("_rows") > 0).drop("_rows")
    # Listing multiplies the cells: as many tasks as a full shuffle has.
    cells = cells.repartition(explosion_tasks(cells), *sources) if sources else cells
    masks = sorted({m & sum(1 << a.index for a in rest) for m in asked.masks})
    nodes = _listed(cells, masks, rest).groupBy("node").agg(outermost("best").alias("best"))
    met = _asked_nodes(asked.probes.withColumn("end", end), rest, ["end"]).join(nodes, "node")
    return met.where(good).groupBy("probe").agg(F.first("n").alias("n"))


def _fold(
    catalog: DataFrame, constraints: DataFrame, folded: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Folded columns and constants; the columns as they are stay beside them."""
    if not folded:
        return catalog, constraints
    catalog = catalog.withColumns(
        {**{f"_plain_{c}": named(c) for c in folded}, **{c: normalise_category(named(c)) for c in folded}}
    )
    plain = F.transform("values", normalise_category)
    return catalog, constraints.withColumn(
        "values", F.when(F.col("col").isin(list(folded)), plain).otherwise(F.col("values"))
    )


def _prepare(
    catalog: DataFrame,
    requests: DataFrame,
    constraints: DataFrame,
    relevance: DataFrame,
    inline_constants: int,
    joins: dict,
    bare: bool = False,
) -> _Asked:
    """`bare` leaves the constrained columns of the catalog only."""
    values = _condition_values(constraints)
    axes, inline, table = _constants(values, catalog, inline_constants)
    fuzzy = [a.name for a in axes if "~" in a.ops]
    if fuzzy:
        constraints = expand_close(catalog, constraints, fuzzy, joins)
        values = _condition_values(materialise(constraints, "conditions"))
        axes, inline, table = _constants(values, catalog, inline_constants)
    if bare and axes:
        catalog = catalog.select(*[named(a.name) for a in axes])
        if any(a.numeric and (a.own is not None or a.name not in inline) for a in axes):
            # Equal rows would stay together however a hot value is spread.
            catalog = catalog.distinct()
    cells, coded = _encode(catalog, values, axes, inline, table, joins)
    profiles = materialise(_profiles(requests, coded, relevance, axes), "profiles")
    levels, probes = _probes(profiles, axes)
    # Which columns are constrained together: few rows, as there are few columns.
    masks = [r["m"] for r in probes.select(_mask(axes, "w").alias("m")).distinct().collect()]
    return _Asked(axes, cells, profiles, levels, probes, masks)


def batch_rows(answers: DataFrame) -> DataFrame:
    """One row per answer row, `pos` from 1; requests without rows do not appear."""
    return answers.select("request_id", "level", F.inline("rows"))


def batch_levels(answers: DataFrame, relevance: DataFrame) -> DataFrame:
    """Per request how many labels were given up, which, and whether nothing was left, from
    the answers of `relax_batch` or `relax_levels`."""
    empty = F.col("is_empty") if "is_empty" in answers.columns else F.col("rows").isNull()
    reached = answers.select("request_id", "level", empty.alias("is_empty"))
    dropped = (
        rank_relevance(relevance)
        .join(reached.select("request_id", "level"), "request_id")
        .where(F.col("rk") <= F.col("level"))
        .groupBy("request_id")
        .agg(F.array_sort(F.collect_list(F.struct("rk", "col"))).alias("gone"))
    )
    return reached.join(dropped, "request_id", "left").select(
        "request_id",
        "level",
        F.concat_ws(",", F.transform("gone", lambda g: g["col"])).alias("dropped"),
        "is_empty",
    )


def dropped_columns(relevance: DataFrame, levels: DataFrame) -> DataFrame:
    """(request_id, col) of every label given up at the reached level."""
    return (
        rank_relevance(relevance)
        .join(levels.select("request_id", "level"), "request_id")
        .where(F.col("rk") <= F.col("level"))
        .select("request_id", "col")
        .distinct()
    )


def _condition_values(constraints: DataFrame) -> DataFrame:
    return constraints.select(
        "request_id", "ord", "col", "op", F.posexplode_outer("values").alias("vpos", "value")
    )


def _constants(
    values: DataFrame, catalog: DataFrame, inline_constants: int
) -> tuple[list[_Axis], dict[str, list], DataFrame | None]:
    """The constrained columns; their distinct constants as rows (value, number, n)
    where there are few; and the table of all constants, unless all are few."""
    uses = (
        values.where(F.col("col").isin(catalog.columns))
        .groupBy("col", "op", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("number", _finite(F.col("value").try_cast("double")))
    )
    rows = uses.limit(inline_constants + 1).collect()
    table, beyond = None, {}
    if len(rows) > inline_constants:
        table = materialise(uses, "constants")
        sizes = (
            table.groupBy("col")
            .agg(
                F.collect_set("op").alias("ops"),
                F.count_distinct("value").alias("size"),
                F.coalesce(F.max(F.abs("number")), F.lit(0.0)).alias("largest"),
            )
            .collect()
        )
        operators = {r["col"]: set(r["ops"]) for r in sizes}
        beyond = {r["col"]: r["largest"] for r in sizes}
        few = [r["col"] for r in sizes if r["size"] <= inline_constants]
        rows = table.where(F.col("col").isin(few)).collect()
    else:
        operators = {r["col"]: set() for r in rows}
        few = list(operators)
        for row in rows:
            operators[row["col"]].add(row["op"])
    inline: dict[str, dict] = {name: {} for name in few}
    for row in rows:
        inline[row["col"]].setdefault(row["value"], row)
    types = {f.name: f.dataType for f in catalog.schema.fields}
    names = [c for c in catalog.columns if c in operators]
    axes = []
    for i, c in enumerate(names):
        kind, ops = types[c], operators[c]
        ordered = isinstance(kind, (T.NumericType, *TIMES)) or bool(ops & RANGE_OPS)
        axis = _Axis(i, c, ordered, ops)
        if isinstance(kind, (T.NumericType, *TIMES)) and "~" in ops:
            raise ValueError(f"~ not supported on {c}")
        if ordered:
            largest = beyond.get(c)
            if largest is None:
                largest = max((abs(r["number"] or 0) for r in inline.get(c, {}).values()), default=0)
            axis.own = _own_type(kind, largest)
        axes.append(axis)
    return axes, {name: list(found.values()) for name, found in inline.items()}, table


def _encode(
    catalog: DataFrame,
    values: DataFrame,
    axes: list[_Axis],
    inline: dict[str, list],
    table: DataFrame | None,
    joins: dict,
) -> tuple[DataFrame, DataFrame]:
    """Catalog with one key-source column `c{i}` per axis, and condition values with
    their cell `code` (numeric axes)."""
    cells = catalog
    literal_codes: list[tuple] = []
    ranked_codes: list[DataFrame] = []
    for axis in axes:
        source = named(axis.name)
        if not axis.numeric:
            if axis.name in inline:
                wanted = [r["value"] for r in inline[axis.name] if r["value"] is not None]
                source = F.when(source.isin(wanted), source)
            cells = cells.withColumn(f"c{axis.index}", source)
            continue
        if axis.own is not None:
            cells = cells.withColumn("_own", source.cast(axis.own))
            mine = values.where((F.col("col") == axis.name) & F.col("value").isNotNull())
            mine = mine.groupBy("col", "value").agg(F.count(F.lit(1)).alias("n"))
            mine = materialise(mine.withColumn("number", _typed(F.col("value"), axis.own)), "typed")
            cells, code = _ranked_cells(cells, mine, axis, joins)
            ranked_codes.append(code)
            continue
        cells = cells.withColumn("_own", _finite(source.cast("double")))
        if axis.name in inline:
            cells, codes = _inline_cells(cells, inline[axis.name], axis)
            literal_codes += codes
        else:
            mine = table.where(F.col("col") == axis.name).groupBy("col", "value", "number")
            cells, code = _ranked_cells(cells, mine.agg(F.sum("n").alias("n")), axis, joins)
            ranked_codes.append(code)
    literal = values.sparkSession.createDataFrame(
        literal_codes, "col string, value string, code int, n long"
    )
    if not ranked_codes:
        # Bounded by axes x inline_constants.
        return cells, values.join(F.broadcast(literal.drop("n")), ["col", "value"], "left")
    if literal_codes and table is not None:
        # Uses per constant, over all operators.
        sums = table.groupBy("col", "value").agg(F.sum("n").alias("n"))
        literal = literal.drop("n").join(sums, ["col", "value"])
    dictionary = reduce(DataFrame.unionByName, ranked_codes, literal)
    return cells, join_back(values, dictionary, ["col", "value"], ["request_id"], **joins)


def _own_type(kind: T.DataType, largest: float) -> T.DataType | None:
    """The type in which a column has to be compared; none where doubles are exact."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.FloatType, T.DoubleType)):
        return None
    if isinstance(kind, T.LongType):
        return T.DecimalType(38, 18) if largest >= EXACT else None
    if isinstance(kind, T.DecimalType):
        return T.DecimalType(38, max(kind.scale, 38 - 20)) if kind.precision > 15 else None
    return kind


def _typed(value: Column, kind: T.DataType) -> Column:
    """A constant in the type of its column; numbers beyond that type as its ends."""
    if not isinstance(kind, T.DecimalType):
        return value.try_cast(kind)
    number = value.try_cast("double")
    end = F.lit("9" * (kind.precision - kind.scale)).cast(kind)
    return F.coalesce(value.try_cast(kind), F.when(number > 0, end).when(number < 0, -end).cast(kind))


def _finite(number: Column) -> Column:
    """NaN counts as missing, infinities as the largest numbers, -0.0 as 0.0."""
    bounded = F.greatest(F.least(number, F.lit(MAX_DOUBLE)), F.lit(-MAX_DOUBLE))
    return F.when(number.isNotNull() & ~F.isnan(number), bounded + F.lit(0.0))


def _inline_cells(
    cells: DataFrame, rows: list, axis: _Axis
) -> tuple[DataFrame, list[tuple]]:
    """Few constants: cut points {b} and the gaps between them, looked up by binary search."""
    points = {r["number"] for r in rows if r["number"] is not None}
    cuts = sorted({c for p in points for c in (p, nextafter(p, inf))} - {inf})
    splits = [-inf, *cuts, inf]
    place = {c: i for i, c in enumerate(splits)}
    axis.depth = depth_for(len(splits))
    codes = [
        (r["col"], r["value"], None if r["number"] is None else place[r["number"]], r["n"])
        for r in rows
    ]
    if len(splits) < 3:
        found = F.when(F.col("_own").isNotNull(), F.lit(0))
        return cells.withColumn(f"c{axis.index}", found).drop("_own"), codes
    cells = Bucketizer(
        splits=splits, inputCol="_own", outputCol="_cell", handleInvalid="keep"
    ).transform(cells)
    found = F.when(F.col("_own").isNotNull(), F.col("_cell").cast("int"))
    return cells.withColumn(f"c{axis.index}", found).drop("_own", "_cell"), codes


def _ranked_cells(
    cells: DataFrame, mine: DataFrame, axis: _Axis, joins: dict
) -> tuple[DataFrame, DataFrame]:
    """Many constants: cells from distributed positions, 2 x (constants below) + hit."""
    points = mine.where(F.col("number").isNotNull()).select(F.col("number")).distinct()
    have = cells.where(F.col("_own").isNotNull()).groupBy(F.col("_own").alias("number"))
    have = have.agg(F.count(F.lit(1)).alias("rows"))
    marked = have.select("number", F.lit(0).alias("mark")).unionByName(
        points.withColumn("mark", F.lit(1))
    )
    places = materialise(
        value_positions(marked, "number", weight=F.col("mark")).select(
            "number", (2 * F.col("before") + F.col("n")).cast("int").alias("place")
        ),
        "places",
    )
    axis.depth = depth_for(2 * points.count() + 1)
    keyed = places.join(have, "number").select(
        F.col("number").alias("_own"),
        F.col("place").alias(f"c{axis.index}"),
        F.col("rows").alias("_rows"),
    )
    cells = join_back(cells, keyed, ["_own"], cells.columns, n="_rows", **joins).drop("_own")
    code = mine.join(places, "number", "left").select(
        "col", "value", F.col("place").alias("code"), "n"
    )
    return cells, code


def _profiles(
    requests: DataFrame, coded: DataFrame, relevance: DataFrame, axes: list[_Axis]
) -> DataFrame:
    """One row per request: bounds and rank per axis, label count, and their text `sig`.

    Conditions and labels meet in one exchange on request_id; ranking and
    grouping both reuse it.
    """
    facts = (
        coded.withColumn("kind", F.lit("condition"))
        .unionByName(
            relevance.select("request_id", "col", "score", F.lit("label").alias("kind")),
            allowMissingColumns=True,
        )
        .unionByName(
            requests.select("request_id", F.lit("request").alias("kind")),
            allowMissingColumns=True,
        )
        .repartition(explosion_tasks(requests), "request_id")
    )
    is_label = F.col("kind") == "label"
    order = Window.partitionBy("request_id", "kind").orderBy("score", "col")
    facts = facts.withColumn("rk", F.when(is_label, F.row_number().over(order)))
    is_condition = F.col("kind") == "condition"

    wide = [F.coalesce(F.max("rk"), F.lit(0)).alias("n_labels")]
    for a in axes:
        here = F.col("col") == a.name
        mine = is_condition & here
        op, vpos, code = F.col("op"), F.col("vpos"), F.col("code")
        wide += [
            F.coalesce(F.bool_or(mine), F.lit(False)).alias(f"has{a.index}"),
            F.min(F.when(is_label & here, F.col("rk"))).alias(f"rk{a.index}"),
        ]
        if a.numeric:
            lower = F.when(op.isin("=", ">=") | ((op == "between") & (vpos == 0)), code).when(
                op == ">", code + 1
            )
            upper = F.when(op.isin("=", "<=") | ((op == "between") & (vpos == 1)), code).when(
                op == "<", code - 1
            )
            listed = mine & (op == "in")
            wide += [
                F.max(F.when(mine, lower)).alias(f"lo{a.index}"),
                F.min(F.when(mine, upper)).alias(f"hi{a.index}"),
                F.bool_or(mine & (op != "in") & code.isNull()).alias(f"bad{a.index}"),
                F.collect_set(
                    F.when(listed, F.struct(F.col("ord"), code.alias("v")))
                ).alias(f"in{a.index}"),
            ]
        else:
            wide += [
                F.collect_set(
                    F.when(mine, F.struct(F.col("ord"), F.col("value").alias("v")))
                ).alias(f"in{a.index}"),
            ]
    grouped = facts.groupBy("request_id").agg(*wide)
    for a in axes:
        grouped = grouped.withColumn(f"pts{a.index}", _common(F.col(f"in{a.index}")))
    wish = []
    for a in axes:
        i = a.index
        fields = [F.col(f"pts{i}").alias("pts")]
        if a.numeric:
            last = (1 << a.depth) - 1
            low = F.when(F.col(f"bad{i}"), last).otherwise(F.coalesce(f"lo{i}", F.lit(0)))
            high = F.when(F.col(f"bad{i}"), -1).otherwise(F.coalesce(f"hi{i}", F.lit(last)))
            fields += [low.alias("lo"), high.alias("hi")]
        wish.append(F.when(F.col(f"has{i}"), F.struct(*fields)).alias(f"w{i}"))
        wish.append(F.col(f"rk{i}"))
    shaped = grouped.select("request_id", "n_labels", *wish)
    parts = [c for c in shaped.columns if c != "request_id"]
    return shaped.withColumn("sig", F.to_json(F.struct(*parts)))


def _common(pairs: Column) -> Column:
    """Values listed by every in-list or equality a request has on one column; null
    when it has none."""
    lists = F.size(F.array_distinct(F.transform(pairs, lambda p: p["ord"])))
    distinct = F.array_sort(F.array_distinct(F.transform(pairs, lambda p: p["v"])))
    common = F.filter(
        distinct,
        lambda v: v.isNotNull() & (F.size(F.filter(pairs, lambda p: p["v"] == v)) == lists),
    )
    return F.when(lists > 0, common)


def _probes(profiles: DataFrame, axes: list[_Axis]) -> tuple[DataFrame, DataFrame]:
    """(sig, level, probe) with the conditions left at each level, and distinct probes."""
    state = [c for a in axes for c in (f"w{a.index}", f"rk{a.index}")]
    # A column's rank matters only where the request has a condition on it.
    steps = F.array(
        F.lit(0),
        *[F.when(F.col(f"w{a.index}").isNotNull(), F.col(f"rk{a.index}")) for a in axes],
    )
    steps = F.filter(F.array_distinct(steps), lambda s: s.isNotNull())
    signatures = profiles.groupBy("sig").agg(
        F.count(F.lit(1)).alias("n_sig"), *[F.first(c).alias(c) for c in state]
    )
    level = F.col("level")
    left = [
        F.when(
            F.col(f"rk{a.index}").isNull() | (F.col(f"rk{a.index}") > level),
            F.col(f"w{a.index}"),
        ).alias(f"w{a.index}")
        for a in axes
    ]
    exploded = signatures.withColumn("level", F.explode(steps)).select(
        "sig", "n_sig", "level", *left
    )
    wishes = [f"w{a.index}" for a in axes]
    probe = F.to_json(F.struct(*wishes)) if wishes else F.lit("{}")
    exploded = exploded.withColumn("probe", probe)
    probes = materialise(
        exploded.groupBy("probe").agg(
            F.count(F.lit(1)).alias("n"), *[F.first(w).alias(w) for w in wishes]
        ),
        "probes",
    )
    return exploded.drop(*wishes), probes


def _best_cells(
    cells: DataFrame, axes: list[_Axis], key: str, price: str, payload: Sequence[str], n: int,
    folded: Sequence[str] = (),
) -> DataFrame:
    """The best `n` catalog rows of each distinct cell."""
    sources = [f"c{a.index}" for a in axes]

    def plain(c: str) -> Column:
        return named(f"_plain_{c}" if c in folded else c).alias(c)

    kept = cells.select(
        *sources,
        plain(price).alias("_price"),
        plain(key).alias("_key"),
        F.struct(plain(price), plain(key), *[plain(c) for c in payload]).alias("row"),
    )
    # Each cell is about to be met many times: keep the tasks as many as a full
    # shuffle has, however small the cells are on disk.
    return _best(kept, sources, _by_price(), n).repartition(explosion_tasks(cells), "_key")


def _by_price() -> list[Column]:
    return [F.col("_price").asc_nulls_last(), F.col("_key").asc()]


def _node_rows(kept: DataFrame, masks: list[int], axes: list[_Axis], n: int) -> DataFrame:
    """The best `n` catalog rows under every node."""
    return _best(_listed(kept, masks, axes), ["node"], _by_price(), n)


def _listed(kept: DataFrame, masks: list[int], axes: list[_Axis]) -> DataFrame:
    """Cells under their nodes, for the column sets that are asked for: a cell is listed
    once per mask, under nodes of that mask's columns only."""
    missing = reduce(
        lambda x, y: x + y,
        [F.when(F.col(f"c{a.index}").isNull(), F.lit(1 << a.index)).otherwise(0) for a in axes],
        F.lit(0),
    ).cast("long")
    asked = F.array(*[F.lit(m).cast("long") for m in masks or [0]])
    kept = kept.withColumn("_missing", missing)
    kept = kept.withColumn(
        "mask", F.explode(F.filter(asked, lambda m: m.bitwiseAND(F.col("_missing")) == 0))
    ).drop("_missing")
    for a in axes:
        have = F.col(f"c{a.index}")
        if a.numeric:
            nodes = ancestors(have, a.depth)
            if a.parity is not None:
                nodes = F.filter(nodes, lambda x: x % 2 == a.parity)
            none = F.array(F.lit(None).cast("int"))
        else:
            nodes = F.array(have)
            none = F.array(F.lit(None).cast("string"))
        used = F.col("mask").bitwiseAND(F.lit(1 << a.index).cast("long")) != 0
        kept = kept.withColumn(a.key, F.explode(F.when(used, nodes).otherwise(none)))
        kept = kept.drop(f"c{a.index}")
    return kept.withColumn("node", _node(axes)).drop("mask", *[a.key for a in axes])


def _walk(
    cells: DataFrame, probes: DataFrame, axes: list[_Axis], n: int, probe_bytes: int
) -> DataFrame:
    """(probe, n, rows): the stated set of probes meets cells in ranges of price. Probes
    travel in blocks of weighed text, one pass over the cells each."""
    total = probes.agg(F.sum(F.octet_length("probe"))).first()[0] or 0
    blocks = max(1, -(-total // probe_bytes))
    wishes = [f"w{a.index}" for a in axes]
    named_probes = probes.withColumn("id", F.unhex(F.md5("probe")))
    if blocks > 1:
        cells = materialise(cells, "cells")
    dealt = cells.repartitionByRange(explosion_tasks(cells), *_by_price()).sortWithinPartitions(*_by_price())
    met = []
    for block in range(blocks):
        mine = named_probes.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block)
        asked = [(bytes(r["id"]), probe_of(r, axes)) for r in mine.select("id", *wishes).collect()]
        met.append(first_rows(dealt, asked, axes, n))
    place = F.row_number().over(Window.partitionBy("id").orderBy(*_by_price()))
    top = reduce(DataFrame.unionByName, met).withColumn("pos", place).where(F.col("pos") <= n)
    rows = top.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "row.*"))).alias("rows"))
    return rows.join(named_probes.select("id", "probe", "n"), "id").drop("id")


def _node(axes: list[_Axis]) -> Column:
    """All axes as one text key, `*` meaning "any"; lengths keep texts apart. As a
    single column it is partitioned and sorted once, for the ranking and the join."""
    parts = []
    for a in axes:
        key = F.col(a.key)
        text = key.cast("string") if a.numeric else F.concat_ws(":", F.length(key), key)
        parts.append(F.when(key.isNull(), "*").otherwise(text))
    return F.concat_ws("|", *parts) if parts else F.lit("")


def _mask(axes: list[_Axis], prefix: str) -> Column:
    """Which axes are constrained, as a bit set."""
    return reduce(
        lambda x, y: x + y,
        [F.when(F.col(f"{prefix}{a.index}").isNotNull(), 1 << a.index).otherwise(0) for a in axes],
        F.lit(0),
    )


def _best(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """First `n` rows per key; Spark trims each task's rows before the exchange."""
    if not by:
        return df.orderBy(*order).limit(n)
    window = Window.partitionBy(*by).orderBy(*order)
    return (
        df.withColumn("_place", F.row_number().over(window))
        .where(F.col("_place") <= n)
        .drop("_place")
    )


def _search(nodes: DataFrame, probes: DataFrame, axes: list[_Axis], n: int) -> DataFrame:
    """(probe, n, rows): node keys of each probe met with the node table."""
    return _top_rows(_asked_nodes(probes, axes).join(nodes, "node"), n)


def _asked_nodes(probes: DataFrame, axes: list[_Axis], keep: Sequence[str] = ()) -> DataFrame:
    """(probe, n, node): the nodes that make up each probe."""
    asked = probes.select("probe", "n", *keep, *[f"w{a.index}" for a in axes])
    asked = asked.repartition(explosion_tasks(probes), "probe")
    for a in axes:
        wish = F.col(f"w{a.index}")
        if a.numeric:
            points = F.transform(
                F.filter(wish["pts"], lambda c: c.between(wish["lo"], wish["hi"])),
                lambda c: leaf(c, a.depth),
            )
            keys = F.when(wish["pts"].isNotNull(), points).otherwise(
                interval_cover(wish["lo"], wish["hi"], a.depth)
            )
            none = F.array(F.lit(None).cast("int"))
        else:
            keys = wish["pts"]
            none = F.array(F.lit(None).cast("string"))
        keys = F.when(wish.isNull(), none).otherwise(keys)
        asked = asked.withColumn(a.key, F.explode(keys)).drop(f"w{a.index}")
    return asked.withColumn("node", _node(axes)).drop(*[a.key for a in axes])


def _top_rows(met: DataFrame, n: int) -> DataFrame:
    """(probe, n, rows): the best `n` rows met by each probe."""
    place = F.row_number().over(Window.partitionBy("probe").orderBy(*_by_price()))
    top = met.withColumn("pos", place).where(F.col("pos") <= n)
    return top.groupBy("probe").agg(
        F.first("n").alias("n"),
        F.array_sort(F.collect_list(F.struct("pos", "row.*"))).alias("rows"),
    )
