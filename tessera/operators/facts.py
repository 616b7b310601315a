"""Flow edges from fact tables: the joins that turn calls, assignments, returns and overrides into parent -> child.

Fact tables are what a front end for some language writes; ids are those of nodes. `in_source` marks symbols that are
neither implicit nor external.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.closure import reach
from tessera.plans.scratch import materialise

#: Bytes of a table that may be broadcast (Spark's own default), and of a row of few columns there.
SMALL, ROW = 10 << 20, 64


def used(symbols: DataFrame) -> DataFrame:
    """Symbols that are declared in source and not implicit."""
    return symbols.where("in_source and not implicit")


def is_variable(kind: Column | str) -> Column:
    return (F.col(kind) if isinstance(kind, str) else kind).isin("local", "parameter", "field", "property")


def node_kind(kind: Column, is_constant: Column) -> Column:
    """const for constants that are no identifiers, methodReturn for methods, variable for variables, else null."""
    return F.when(is_constant, "const").when(kind == "method", "methodReturn").when(is_variable(kind), "variable")


def reference_symbols(uses: DataFrame, declared: DataFrame) -> DataFrame:
    """(use_id, symbol_id): the original definition of the symbol that a use refers to, else, for a declarator or foreach, the one that it declares.

    uses(use_id, kind, symbol_id, original_id): original_id is null where the symbol is no instance of a generic one;
    declared(use_id, declared_id).
    """
    own = F.coalesce("original_id", "symbol_id")
    fallback = F.when(F.col("kind").isin("declarator", "foreach"), F.col("declared_id"))
    return uses.join(declared.select("use_id", "declared_id"), "use_id", "left").select("use_id", F.when(F.col("symbol_id").isNotNull(), own).otherwise(fallback).alias("symbol_id"))


def variable_types(symbols: DataFrame) -> DataFrame:
    """(symbol_id, type): the type of a local, field, parameter or property; null for range variables and all else."""
    return symbols.select("symbol_id", F.when(is_variable("kind"), F.col("type")).alias("type"))


def resolved_nodes(expressions: DataFrame) -> DataFrame:
    """(expr_id, node_kind, node): what an expression stands for, without one cast around it.

    A constant that is no identifier is a literal (const); a used method its return (methodReturn), another used symbol a
    variable; else both are null. expressions(expr_id, syntax, operand_id, constant, symbol, symbol_kind, in_source, implicit).
    """
    columns = [c for c in expressions.columns if c not in ("expr_id", "operand_id")]
    inner = expressions.select(F.col("expr_id").alias("inner_id"), F.struct(*columns).alias("inner"))
    at = F.when(F.col("syntax") == "cast", F.col("operand_id")).otherwise(F.col("expr_id"))
    held = expressions.select("expr_id", at.alias("inner_id")).join(inner, "inner_id", "left").select("expr_id", "inner.*")
    is_constant = F.col("constant").isNotNull() & (F.col("syntax") != "identifier")
    is_used = F.col("symbol").isNotNull() & F.coalesce("in_source", F.lit(False)) & ~F.coalesce("implicit", F.lit(False))
    kind = F.when(is_constant, "const").when(is_used & (F.col("symbol_kind") == "method"), "methodReturn").when(is_used, "variable")
    return held.select("expr_id", kind.alias("node_kind"), F.when(kind == "const", F.col("constant")).when(kind.isNotNull(), F.col("symbol")).alias("node"))


def resolve_arguments(arguments: DataFrame, parameters: DataFrame) -> DataFrame:
    """(call_id, arg_pos, arg_node, param_node): the parameter of each argument.

    A named argument takes the parameter of that name and nothing else; others the parameter of their position, or
    beyond the last position the trailing parameter array. Arguments without parameter are dropped.
    arguments(call_id, method_id, arg_pos, arg_name, arg_node); parameters(method_id, pos, name, is_array, param_node).
    """
    named = parameters.select("method_id", F.col("name").alias("arg_name"), F.col("param_node").alias("by_name"))
    placed = parameters.select("method_id", F.col("pos").alias("arg_pos"), F.col("param_node").alias("by_pos"))
    trailing = parameters.where("is_array").select("method_id", F.col("pos").alias("array_pos"), F.col("param_node").alias("by_array"))
    joined = arguments.join(named, ["method_id", "arg_name"], "left").join(placed, ["method_id", "arg_pos"], "left").join(trailing, "method_id", "left")
    found = F.when(F.col("arg_name").isNotNull(), F.col("by_name")).otherwise(F.coalesce("by_pos", F.when(F.col("arg_pos") >= F.col("array_pos"), F.col("by_array"))))
    return joined.select("call_id", "arg_pos", "arg_node", found.alias("param_node")).where("param_node is not null")


def argument_edges(arguments: DataFrame, parameters: DataFrame) -> DataFrame:
    """Parameter -> argument."""
    return resolve_arguments(arguments, parameters).select(F.col("param_node").alias("parent_id"), F.col("arg_node").alias("child_id"))


def override_pairs(overrides: DataFrame) -> DataFrame:
    """(method_id, base_id): each method with everything that it overrides or implements, directly or over others."""
    up = overrides.select(F.col("method_id").alias("parent_id"), F.col("base_id").alias("child_id"))
    starts = overrides.select(F.col("method_id").alias("start"), F.col("method_id").alias("node")).distinct()
    return reach(up, starts).where("depth > 0").select(F.col("start").alias("method_id"), F.col("node").alias("base_id"))


def implementations(methods: DataFrame, implements: DataFrame) -> DataFrame:
    """(method_id, base_id): methods with the interface methods of the same signature that they implement.

    Interfaces count that a type names itself or over other interfaces. methods(method_id, type_id, signature, in_source,
    implicit); implements(type_id, interface_id). Methods and interface methods that aren't used symbols are left out.
    """
    up = implements.select(F.col("type_id").alias("parent_id"), F.col("interface_id").alias("child_id"))
    starts = implements.select(F.col("type_id").alias("start"), F.col("type_id").alias("node")).distinct()
    every = reach(up, starts).where("depth > 0").select(F.col("start").alias("type_id"), F.col("node").alias("interface_id"))
    own = used(methods).select("method_id", "type_id", "signature")
    base = own.select(F.col("method_id").alias("base_id"), F.col("type_id").alias("interface_id"), "signature")
    return own.join(every, "type_id").join(base, ["interface_id", "signature"]).select("method_id", "base_id").distinct()


def method_edges(methods: DataFrame, implements: DataFrame, overrides: DataFrame, parameters: DataFrame, returns: DataFrame) -> DataFrame:
    """Edges of all declared methods: to what they implement and what they override, where both are used symbols."""
    ids = used(methods).select("method_id")
    kept = overrides.join(ids, "method_id", "left_semi").join(ids.withColumnRenamed("method_id", "base_id"), "base_id", "left_semi")
    pairs = implementations(methods, implements).union(kept.select("method_id", "base_id")).distinct()
    return override_edges(pairs, parameters, returns)


def override_edges(overrides: DataFrame, parameters: DataFrame, returns: DataFrame) -> DataFrame:
    """Overriding parameter -> base parameter of the same position, and base return -> overriding return, along each direct step.

    Interface implementations are overrides as well. returns(method_id, return_node).
    """
    own = parameters.select("method_id", "pos", F.col("param_node").alias("parent_id"))
    base = parameters.select(F.col("method_id").alias("base_id"), "pos", F.col("param_node").alias("child_id"))
    down = overrides.join(own, "method_id").join(base, ["base_id", "pos"]).select("parent_id", "child_id")
    upper = returns.select(F.col("method_id").alias("base_id"), F.col("return_node").alias("parent_id"))
    lower = returns.select("method_id", F.col("return_node").alias("child_id"))
    return down.union(overrides.join(upper, "base_id").join(lower, "method_id").select("parent_id", "child_id"))


def assignment_edges(assignments: DataFrame) -> DataFrame:
    """Left -> right side; element accesses on the left are ignored, as are sides that are no used symbol.

    assignments(left_node, left_kind, right_node).
    """
    return assignments.where("left_kind <> 'element_access' and left_node is not null and right_node is not null").select(F.col("left_node").alias("parent_id"), F.col("right_node").alias("child_id"))


def initializer_edges(initializers: DataFrame) -> DataFrame:
    """Declared variable -> the symbol on the right, else the literal. initializers(declared_node, symbol_node, literal_node)."""
    right = F.coalesce("symbol_node", "literal_node")
    return initializers.select(F.col("declared_node").alias("parent_id"), right.alias("child_id")).where("parent_id is not null and child_id is not null")


def dyadic(intervals: DataFrame) -> DataFrame:
    """intervals(start, end, ...) with their cover (level, cell): cell c of level k holds the positions c 2^k to (c + 1) 2^k - 1.

    Cells of a cover don't overlap and hold just the interval: two a level at most. A position lies in one cell of each level
    (`cells`), so an equi-join on (level, cell) finds each interval around it once, and none besides. Positions are whole numbers.
    """
    bounds = intervals.where(F.col("start") <= F.col("end"))
    # at level k what is left to cover is from cell lo to before cell hi; an odd lo, or an odd hi, ends it on that side
    levels = "sequence(0, length(bin(cast(end as bigint) - start + 1)) - 1)"
    lo, hi = "(shiftright(cast(start as bigint) - 1, k) + 1)", "shiftright(cast(end as bigint) + 1, k)"
    left = f"if({lo} < {hi} and {lo} & 1 = 1, named_struct('level', k, 'cell', {lo}), null)"
    right = f"if({lo} < {hi} and {hi} & 1 = 1, named_struct('level', k, 'cell', {hi} - 1), null)"
    cover = F.expr(f"filter(flatten(transform({levels}, k -> array({left}, {right}))), x -> x is not null)")
    return bounds.withColumn("_at", F.explode(cover)).select(*intervals.columns, "_at.level", "_at.cell")


def cells(places: DataFrame, cover: DataFrame) -> DataFrame:
    """places(pos, ...) once for each level that occurs in a cover, with its cell there."""
    every = places.crossJoin(F.broadcast(cover.select("level").distinct()))
    return every.withColumn("cell", F.expr("shiftright(cast(pos as bigint), level)"))


def enclosing(points: DataFrame, scopes: DataFrame, *carried: str) -> DataFrame:
    """(file, pos, best): for each place of points the rank of its innermost scope, with its scope_id and carried columns.

    Each cell of the scopes' covers keeps its best scope, and each place takes the best of its cells: the work is that of
    places and scopes times levels, however many scopes hold a place.
    """
    own = F.struct("scope_id", *carried).alias("own")
    rank = F.struct((F.col("end") - F.col("start")).alias("size"), (-F.col("start")).alias("from"), *(F.col(f"own.{name}") for name in ("scope_id", *carried)))
    one = scopes.groupBy("file", "start", "end").agg(F.min(own).alias("own"))
    best = materialise(dyadic(one).groupBy("file", "level", "cell").agg(F.min(rank).alias("best")))
    places = points.select("file", "pos").distinct()
    return cells(places, best).join(best, ["file", "level", "cell"]).groupBy("file", "pos").agg(F.min("best").alias("best"))


def innermost(points: DataFrame, scopes: DataFrame) -> DataFrame:
    """(point_id, scope_id): the smallest scope of the file that holds each position.

    points(point_id, file, pos); scopes(scope_id, file, start, end); of equally small scopes the one that starts last, then
    the smallest id.
    """
    held = enclosing(points, scopes)
    return points.select("point_id", "file", "pos").join(held, ["file", "pos"]).groupBy("point_id").agg(F.min("best").alias("best")).select("point_id", "best.scope_id")


def return_edges(returns: DataFrame, scopes: DataFrame) -> DataFrame:
    """Return node (or property, for an accessor) of the innermost enclosing method or lambda -> returned expression.

    returns(point_id, file, pos, expression_node); scopes as for `innermost`, with return_node. The scope brings its return
    node along, so returns move twice: to their places and to their ids. Each expression of a return gives one edge.
    """
    at = returns.where("expression_node is not null").select("point_id", "file", "pos", "expression_node")
    held = enclosing(at, scopes, "return_node")
    best = F.min("best").over(Window.partitionBy("point_id"))
    found = at.join(held, ["file", "pos"]).select("point_id", best.alias("best"), "expression_node")
    edges = found.select("point_id", F.col("best.return_node").alias("parent_id"), F.col("expression_node").alias("child_id"))
    return edges.where("point_id is not null and parent_id is not null").distinct().select("parent_id", "child_id")


def operator_edges(binaries: DataFrame, parameters: DataFrame) -> DataFrame:
    """Parameters of user-defined binary operators -> their operands. binaries(method_id, left_node, right_node)."""
    side = lambda pos, node: binaries.select("method_id", F.col(node).alias("child_id")).join(parameters.where(F.col("pos") == pos).select("method_id", F.col("param_node").alias("parent_id")), "method_id")
    return side(0, "left_node").unionByName(side(1, "right_node")).select("parent_id", "child_id").where("child_id is not null")


def all_edges(*parts: DataFrame) -> DataFrame:
    """Union of edge tables with set semantics, without loops."""
    out = parts[0].select("parent_id", "child_id")
    for part in parts[1:]:
        out = out.union(part.select("parent_id", "child_id"))
    return out.where("parent_id <> child_id").distinct()


def node_key(kind: Column, file: Column, line: Column, name: Column, value_type: Column, value: Column) -> Column:
    """Identity of a node: constants by type and value wherever they are, others by kind, file, line and name. Null parts are equal."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit("\x00"))
    return F.when(kind == "const", F.concat_ws("\x01", F.lit("const"), part(value_type), part(value))).otherwise(F.concat_ws("\x01", kind, part(file), part(line), part(name)))


def united(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, start, end): the fewest intervals of each key that hold the positions of all its intervals; whole numbers."""
    one = intervals.where(F.col("start") <= F.col("end")).groupBy(*keys, "start").agg(F.max("end").alias("end"))
    order = Window.partitionBy(*keys).orderBy("start")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = one.withColumn("opens", (before.isNull() | (F.col("start") > before + 1)).cast("long")).withColumn("island", F.sum("opens").over(order))
    return opened.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def names_in_scope(places: DataFrame, named: DataFrame) -> DataFrame:
    """(file, type, pos, in_scope): the sorted names of the scopes of its file and type that hold each place, where there are any.

    places(file, type, pos); named(name, type, file, start, end). Scopes of one name are united, so a place meets each of
    its names once, and names are looked up once for all that is at a place.
    """
    held = named.select(F.col("name").alias("candidate"), "type", "file", "start", "end").where("candidate is not null")
    names = dyadic(united(held, ["file", "type", "candidate"])).groupBy("file", "type", "level", "cell").agg(F.collect_list("candidate").alias("names"))
    names = materialise(names)
    met = cells(places.select("file", "type", "pos").distinct(), names).join(names, ["file", "type", "level", "cell"])
    return met.groupBy("file", "type", "pos").agg(F.array_sort(F.flatten(F.collect_list("names"))).alias("in_scope"))


def looked_up(rows: DataFrame, texts: DataFrame, keys: list[str], text: str, most: int = SMALL) -> DataFrame:
    """rows with the text of their keys; rows without one are left out. texts(*keys, text): one row a key.

    Where keys and distinct texts take about `most` bytes each, or less, both are broadcast: rows stay in their tasks, and are
    ordered there so that equal texts stand together, as files need several times the space without. Else rows are shuffled
    by their keys, which orders them as well.
    """
    texts = materialise(texts)
    distinct = materialise(texts.select(text).distinct().withColumn("_text", F.monotonically_increasing_id()))
    size = distinct.agg(F.coalesce(F.sum(F.octet_length(text) + ROW), F.lit(0))).first()[0]
    if max(size, texts.count() * ROW) > most:
        return rows.join(texts, keys)
    ids = texts.join(F.broadcast(distinct), text).select(*keys, "_text")
    met = rows.join(F.broadcast(ids), keys).sortWithinPartitions("_text")
    kept = met.withColumn("_row", F.monotonically_increasing_id()).where("_row >= 0")  # else the join drops the order
    return kept.join(F.broadcast(distinct), "_text").drop("_text", "_row")


def in_scope(uses: DataFrame, scopes: DataFrame, symbols: DataFrame) -> DataFrame:
    """(use_id, symbol, in_scope): for each use the names of the symbols of its type whose scope holds it.

    uses(use_id, file, pos, symbol, type); symbols(name, type, scope_id); scopes(scope_id, file, start, end).
    """
    found = names_in_scope(uses, symbols.join(scopes, "scope_id"))
    empty = F.array().cast("array<string>")
    return uses.select("use_id", "symbol", "file", "type", "pos").join(found, ["file", "type", "pos"], "left").select("use_id", "symbol", F.coalesce("in_scope", empty).alias("in_scope"))
