"""From the algebra to DataFrames.

A relation has a column a variable, an encoded term or null for unbound. `bound` holds the variables that no row leaves unbound: joins on those are plain
equi-joins; joins on others are compatibility joins (equal, or unbound on a side). Constants of a pattern become filters on the columns of the triple
table, so a table partitioned by p is pruned and the rest is pushed to its scan."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions.grams import contained_between
from ..sources.store import written
from .algebra import BGP, Aggregate, Call, Distinct, Exists, Extend, Filter, Graph, Group, Join, LeftJoin, Minus, OrderBy, Path, Pattern, Project, Query, Slice, Union, Values, Var, variables
from .paths import Paths, closes, flip

#: A closure starts from bound values if there are fewer than one in so many steps.
MANY = 10
BOOLEAN, INTEGER, DECIMAL, DOUBLE = (T.XSD + x for x in ("boolean", "integer", "decimal", "double"))


@dataclass
class Relation:
    df: DataFrame
    vars: list[str]
    bound: set[str]


def null() -> Column:
    return F.lit(None).cast("string")


def column(v: str) -> Column:
    return F.col(f"`{v}`")


class Compiler:
    def __init__(self, triples: DataFrame, bindings: dict[str, str] | None = None, query: Query | None = None, quads: bool = False) -> None:
        self.triples, self.spark, self.quads = triples, triples.sparkSession, quads
        self.bindings = bindings or {}
        self.default, self.named = (query.default, query.named) if query else (None, None)
        self.graph: Any = None  # what GRAPH names around the pattern at hand
        self.number = 0

    def fresh(self, tag: str) -> str:
        self.number += 1
        return f".{tag}{self.number}"

    # Graphs
    @property
    def ranging(self) -> str | None:
        """The variable that ranges over the named graphs, if patterns are inside such a GRAPH."""
        return self.graph.name if isinstance(self.graph, Var) else None

    def source(self) -> tuple[DataFrame, bool]:
        """The triples that a pattern sees, and whether one may be there more than once."""
        if (self.graph is not None or self.default is not None) and "src" not in self.triples.columns:
            raise ValueError("the triples have no column src, which tells graphs apart")
        if self.graph is None:
            if self.default is None:
                return self.triples, self.quads
            return self.triples.where(T.in_graphs(self.default)), self.quads and len(set(self.default)) > 1
        names = self.named
        if isinstance(self.graph, str):
            names = [self.graph] if names is None or self.graph in names else []
        return (self.triples if names is None else self.triples.where(T.in_graphs(names))), False

    def graph_names(self) -> Relation:
        df, _ = self.source()
        return Relation(df.select(T.graph_name(F.col("src")).alias(self.ranging)).distinct(), [self.ranging], {self.ranging})

    def on_graph(self, n: Graph) -> Relation:
        around = self.graph
        self.graph = self.bindings.get(n.name.name, n.name) if isinstance(n.name, Var) else n.name
        try:
            return self.run(n.child)
        finally:
            self.graph = around

    # Patterns
    def unit(self) -> Relation:
        return self.graph_names() if self.ranging else Relation(self.spark.range(1).select(), [], set())

    def scan(self, s: Any, p: str | None, o: Any, names: tuple[str, str | None, str], graph: str | None = None) -> DataFrame:
        """Triples that match the constants, as columns named `names` (p only if it is a variable), and `graph` where one ranges."""
        df, repeats = self.source()
        if p is not None:
            df = df.where(F.col("p") == p[1:])
        if isinstance(s, str):
            df = df.where((F.col("s") == s[1:]) & (F.col("s_kind") == ("uri" if s[0] == "<" else "bnode")))
        if isinstance(o, str):
            if o[0] == '"':
                tag, _, text = o[1:].partition("|")
                df = df.where((F.col("o_kind") == "literal") & (F.col("o") == text))
                df = df.where(F.lower("o_lang") == tag[1:] if tag[:1] == "@" else F.col("o_lang").isNull())
                if tag[:1] == "^":
                    df = df.where(F.col("o_dt") == tag[1:])
                elif tag == "":
                    df = df.where(F.col("o_dt").isNull() | (F.col("o_dt") == T.XSD + "string"))
            else:
                df = df.where((F.col("o_kind") == ("uri" if o[0] == "<" else "bnode")) & (F.col("o") == o[1:]))
        out = [T.encode(F.col("s"), F.col("s_kind")).alias(names[0])]
        if names[1]:
            out.append(F.concat(F.lit("<"), F.col("p")).alias(names[1]))
        out.append(T.encode(F.col("o"), F.col("o_kind"), F.col("o_dt"), F.col("o_lang")).alias(names[2]))
        if graph:
            out.append(T.graph_name(F.col("src")).alias(graph))
        return df.select(*out).distinct() if repeats else df.select(*out)

    def paths(self) -> Paths:
        g = "g" if self.ranging else None
        keys = [g] if g else []

        def nodes() -> DataFrame:
            df, _ = self.source()
            ends = F.array(T.encode(F.col("s"), F.col("s_kind")), T.encode(F.col("o"), F.col("o_kind"), F.col("o_dt"), F.col("o_lang")))
            named = [T.graph_name(F.col("src")).alias(g)] if g else []
            return df.select(*named, F.explode(ends).alias("s")).distinct()

        return Paths(lambda p: self.scan(None, p, None, ("s", None, "o"), g), nodes, keys)

    def along(self, path: Path, s: Any, o: Any, seeds: DataFrame | None, at: str | None) -> DataFrame:
        """Pairs s, o of a path: from the constant end if there is one, or from `seeds`, distinct values of its end `at` (`s` or `o`)."""
        paths = self.paths()
        if seeds is None and (isinstance(s, str) or isinstance(o, str)):
            at = "s" if isinstance(s, str) else "o"
            seeds = self.spark.range(1).select(F.lit(s if at == "s" else o).alias("s"))
            if self.ranging:
                seeds = self.graph_names().df.withColumnRenamed(self.ranging, "g").crossJoin(seeds)  # one row a graph
        if seeds is None:
            return paths.pairs(path)
        return paths.reach(path, seeds) if at == "s" else paths.turned(paths.reach(flip(path), seeds))

    def pattern(self, t: Pattern, seeds: DataFrame | None = None, at: str | None = None) -> Relation:
        s, p, o = (self.bindings.get(x.name, x) if isinstance(x, Var) else x for x in (t.s, t.p, t.o))
        g = Var(self.ranging) if self.ranging else None
        names = (self.fresh("s"), self.fresh("p") if isinstance(p, Var) else None, self.fresh("o"), self.fresh("g") if g else None)
        if isinstance(p, Path):
            df = self.along(p, s, o, seeds, at)
            df = df.select(F.col("s").alias(names[0]), F.col("o").alias(names[2]), *([F.col("g").alias(names[3])] if g else []))
            for term, name in ((s, names[0]), (o, names[2])):
                if isinstance(term, str):
                    df = df.where(column(name) == term)
        else:
            df = self.scan(s, None if isinstance(p, Var) else p, o, names[:3], names[3])
        seen: dict[str, str] = {}
        for term, name in zip((s, p, o, g), names, strict=True):
            if isinstance(term, Var) and name:
                if term.name in seen:
                    df = df.where(column(seen[term.name]) == column(name))
                else:
                    seen[term.name] = name
        df = df.select(*[column(n).alias(v) for v, n in seen.items()])
        return Relation(df, list(seen), set(seen))

    def bgp(self, b: BGP) -> Relation:
        rest = list(b.patterns)
        if not rest:
            return self.unit()
        constants = lambda t: sum(isinstance(x, str) or isinstance(x, Var) and x.name in self.bindings for x in (t.s, t.o))
        names = lambda t: {x.name for x in (t.s, t.p, t.o) if isinstance(x, Var)}
        # Closures without a constant end come last: by then an end may be bound by the others.
        rest.sort(key=lambda t: (closes(t.p) and not constants(t), -constants(t)))
        out = self.pattern(rest.pop(0))
        while rest:  # connected patterns first, so that no product arises that the query does not ask for
            i = next((i for i, t in enumerate(rest) if names(t) & set(out.vars)), 0)
            t = rest.pop(i)
            if closes(t.p) and not constants(t):
                out, found = self.seeded(out, t)
            else:
                found = self.pattern(t)
            out = self.join(out, found)
        return out

    def seeded(self, out: Relation, t: Pattern) -> tuple[Relation, Relation]:
        """A closure whose end is a variable of `out`: from the values that it has there, unless they are a good part of all nodes."""
        ends = [(x.name, at) for x, at in ((t.s, "s"), (t.o, "o")) if isinstance(x, Var) and x.name in out.bound]
        if not ends:
            return out, self.pattern(t)
        out = Relation(written(out.df, "bound")[0], out.vars, out.bound)
        name, at = ends[0]
        keys = [column(self.ranging).alias("g")] if self.ranging else []
        seeds = written(out.df.select(*keys, column(name).alias("s")).distinct(), "ends")[0]
        if isinstance(t.p.args[0], str) and seeds.count() * MANY > self.paths().pairs(t.p.args[0]).count():
            return out, self.pattern(t)  # doubling needs fewer rounds
        return out, self.pattern(t, seeds, at)

    # Joins
    def condition(self, left: Relation, right: Relation, suffix: str) -> tuple[Column | None, list[str]]:
        shared = [v for v in left.vars if v in right.vars]
        on = None
        for v in shared:
            a, b = column(v), column(v + suffix)
            same = a == b
            if v not in left.bound:
                same = same | a.isNull()
            if v not in right.bound:
                same = same | b.isNull()
            on = same if on is None else on & same
        return on, shared

    def join(self, left: Relation, right: Relation, how: str = "inner", test: Any = None) -> Relation:
        suffix = self.fresh("r")
        r = right.df.select(*[column(v).alias(v + suffix) for v in right.vars])
        on, shared = self.condition(left, right, suffix)
        if test is not None:
            merged = {v: F.coalesce(column(v), column(v + suffix)) if v in shared else column(v if v in left.vars else v + suffix) for v in {*left.vars, *right.vars}}
            extra = self.truth(test, merged)
            on = extra if on is None else on & extra
        if how == "inner" and on is None:
            joined = left.df.crossJoin(r)
        else:
            joined = left.df.join(r, on if on is not None else F.lit(True), how)
        names = left.vars + [v for v in right.vars if v not in shared]
        out = []
        for v in names:
            if v in shared and v not in left.bound:
                out.append(F.coalesce(column(v), column(v + suffix)).alias(v))
            elif v in left.vars:
                out.append(column(v))
            else:
                out.append(column(v + suffix).alias(v))
        bound = left.bound | right.bound if how == "inner" else set(left.bound)
        return Relation(joined.select(*out), names, bound)

    def run(self, n: Any) -> Relation:
        return getattr(self, "on_" + type(n).__name__.lower())(n)

    def on_bgp(self, n: BGP) -> Relation:
        return self.bgp(n)

    def on_join(self, n: Join) -> Relation:
        """Patterns that only the other side connects are joined one by one, connected ones first: no product of them arises."""
        apart = lambda x: [BGP(p) for p in _components(x.patterns)] if isinstance(x, BGP) and x.patterns else [x]
        left, right = apart(n.left), apart(n.right)
        if len(left) + len(right) == 2:
            return self.join(self.run(n.left), self.run(n.right))
        rest = [self.run(x) for x in left + right]
        out = rest.pop(next((i for i, x in enumerate(left + right) if not isinstance(x, BGP)), 0))
        while rest:
            i = next((i for i, r in enumerate(rest) if set(r.vars) & set(out.vars)), 0)
            out = self.join(out, rest.pop(i))
        return out

    def on_leftjoin(self, n: LeftJoin) -> Relation:
        return self.join(self.run(n.left), self.run(n.right), "left", n.condition)

    def on_union(self, n: Union) -> Relation:
        a, b = self.run(n.left), self.run(n.right)
        names = a.vars + [v for v in b.vars if v not in a.vars]
        wide = lambda r: r.df.select(*[column(v) if v in r.vars else null().alias(v) for v in names])
        return Relation(wide(a).unionByName(wide(b)), names, a.bound & b.bound)

    def on_minus(self, n: Minus) -> Relation:
        a, b = self.run(n.left), self.run(n.right)
        suffix = self.fresh("m")
        on, shared = self.condition(a, b, suffix)
        if not shared:
            return a
        told = [v for v in shared if v != self.ranging]  # the graph is the same on both sides, but not one of their variables
        if not told:
            return a
        some = reduce(lambda x, y: x | y, [column(v).isNotNull() & column(v + suffix).isNotNull() for v in told])
        r = b.df.select(*[column(v).alias(v + suffix) for v in b.vars])
        return Relation(a.df.join(r, on & some if not set(shared) & a.bound & b.bound else on, "left_anti"), a.vars, a.bound)

    def on_filter(self, n: Filter) -> Relation:
        met = self.contained(n)
        return met if met is not None else self.filtered(self.run(n.child), n.condition)

    def contained(self, n: Filter) -> Relation | None:
        """Filters over patterns that nothing connects but CONTAINS of one text in another: a join by character grams in place of a product."""
        conditions, node = [], n
        while isinstance(node, Filter):
            conditions += _conjuncts(node.condition)
            node = node.child
        parts = _components(node.patterns) if isinstance(node, BGP) and not self.ranging else []
        if len(parts) < 2:
            return None
        owner = {v: i for i, p in enumerate(parts) for t in p for x in (t.s, t.p, t.o) if isinstance(x, Var) for v in [x.name] if v not in self.bindings}
        sides = lambda e: {owner[v] for v in _names(e) if v in owner}
        for c in conditions:
            tests = _alternatives(c)
            if not all(isinstance(x, Call) and x.name == "CONTAINS" for x in tests):
                continue
            x, y = tests[0].args
            if not (len(sides(x)) == len(sides(y)) == 1 and sides(x) != sides(y) and all({*map(repr, a.args)} == {repr(x), repr(y)} for a in tests)):
                continue
            # Filters of a part go first.
            rest, relations = [d for d in conditions if d is not c], {}
            for i, p in enumerate(parts):
                relations[i] = self.bgp(BGP(p))
                for d in [d for d in rest if not _has_exists(d) and sides(d) == {i} and _names(d) <= set(relations[i].vars)]:
                    relations[i] = self.filtered(relations[i], d)
                    rest.remove(d)
            (i,), (j,) = sides(x), sides(y)
            out = self.join_contained(relations.pop(i), relations.pop(j), x, y, [a.args[0] == x for a in tests])
            for r in relations.values():
                out = self.join(out, r)
            for d in rest:
                out = self.filtered(out, d)
            return out
        return None

    def join_contained(self, left: Relation, right: Relation, x: Any, y: Any, ways: list[bool]) -> Relation:
        """Rows whose text x (of left) contains y (of right), for a way that is true, or is contained in it, for one that is not."""
        a, b = self.fresh("x"), self.fresh("y")
        l = left.df.withColumn(a, T.lexical(self.term(x, {v: column(v) for v in left.vars})))
        r = right.df.withColumn(b, T.lexical(self.term(y, {v: column(v) for v in right.vars})))
        texts = lambda df, c: written(df.select(column(c).alias("n")).where("n IS NOT NULL").distinct(), "names")[0]
        xs, ys = texts(l, a), texts(r, b)
        pairs = [contained_between(ys, xs).select(F.col("y").alias(a), F.col("x").alias(b)) if way else contained_between(xs, ys).select(F.col("x").alias(a), F.col("y").alias(b)) for way in sorted(set(ways))]
        joined = l.join(reduce(DataFrame.unionByName, pairs).distinct(), a).join(r, b)
        return Relation(joined.select(*map(column, left.vars + right.vars)), left.vars + right.vars, left.bound | right.bound)

    def filtered(self, child: Relation, condition: Any) -> Relation:
        if isinstance(condition, Call) and condition.name == "&&":
            return self.filtered(self.filtered(child, condition.args[0]), condition.args[1])
        if isinstance(condition, Call) and condition.name == "!" and isinstance(condition.args[0], Exists):
            condition = Exists(condition.args[0].pattern, not condition.args[0].negated)
        if isinstance(condition, Exists):
            inner = self.run(condition.pattern)
            suffix = self.fresh("e")
            on, _ = self.condition(child, inner, suffix)
            r = inner.df.select(*[column(v).alias(v + suffix) for v in inner.vars])
            return Relation(child.df.join(r, on if on is not None else F.lit(True), "left_anti" if condition.negated else "left_semi"), child.vars, child.bound)
        scope = {v: column(v) for v in child.vars}
        known = set(child.bound)
        if isinstance(condition, Call) and condition.name == "BOUND":
            known.add(condition.args[0].name)
        return Relation(child.df.where(self.truth(condition, scope)), child.vars, known)

    def on_extend(self, n: Extend) -> Relation:
        child = self.run(n.child)
        value = self.term(n.expr, {v: column(v) for v in child.vars})
        names = [v for v in child.vars if v != n.var] + [n.var]
        sure = isinstance(n.expr, str) or isinstance(n.expr, Var) and n.expr.name in child.bound
        df = child.df.select(*[column(v) for v in child.vars if v != n.var], value.alias(n.var))
        return Relation(df, names, child.bound | ({n.var} if sure else set()))

    def on_values(self, n: Values) -> Relation:
        schema = ", ".join(f"`{v}` string" for v in n.vars)
        df = self.spark.createDataFrame([tuple(r) for r in n.rows], schema)
        out = Relation(df, n.vars, {v for i, v in enumerate(n.vars) if all(r[i] is not None for r in n.rows)})
        return self.join(out, self.graph_names()) if self.ranging else out

    def on_project(self, n: Project) -> Relation:
        child = self.run(n.child)
        names = n.vars + [v for v in child.vars if v == self.ranging and v not in n.vars]
        df = child.df.select(*[column(v) if v in child.vars else F.lit(self.bindings.get(v)).cast("string").alias(v) for v in names])
        return Relation(df, names, child.bound & set(names))

    def on_distinct(self, n: Distinct) -> Relation:
        child = self.run(n.child)
        return Relation(child.df.distinct(), child.vars, child.bound)

    def on_orderby(self, n: OrderBy) -> Relation:
        child = self.run(n.child)
        return Relation(self.ordered(child, n.keys), child.vars, child.bound)

    def ordered(self, child: Relation, keys: list) -> DataFrame:
        scope, by = {v: column(v) for v in child.vars}, []
        for e, down in keys:
            t = self.term(e, scope)
            rank = F.when(t.isNull(), 0).when(t.startswith("_"), 1).when(t.startswith("<"), 2).otherwise(3)
            for k in (rank, T.number(t), T.moment(t), T.lexical(t), t):
                by.append(k.desc() if down else k.asc())
        return child.df.orderBy(*by)

    def on_slice(self, n: Slice) -> Relation:
        if self.ranging:
            raise NotImplementedError("LIMIT or OFFSET inside GRAPH with a variable: it would hold for each graph")
        # DISTINCT and projection keep the order below them only if the sort is applied last.
        inner, wrap = n.child, []
        while isinstance(inner, (Project, Distinct)):
            wrap.append(inner)
            inner = inner.child
        if isinstance(inner, OrderBy) and any(isinstance(w, Distinct) for w in wrap):
            names = next(w.vars for w in wrap if isinstance(w, Project))
            base = self.run(Distinct(Project(inner.child, names)))
            known = {v for e, _ in inner.keys for v in _names(e)}
            child = Relation(self.ordered(base, inner.keys) if known <= set(names) else base.df, base.vars, base.bound)
        else:
            child = self.run(n.child)
        df = child.df.offset(n.offset) if n.offset else child.df
        return Relation(df.limit(n.limit) if n.limit is not None else df, child.vars, child.bound)

    # Aggregation
    def on_group(self, n: Group) -> Relation:
        split = self.split_counts(n)
        if split is not None:
            return split
        if self.ranging:
            if not n.keys:
                raise NotImplementedError("an aggregate without GROUP BY inside GRAPH with a variable")
            if self.ranging not in [v for v, _ in n.keys]:
                n = Group(n.child, [*n.keys, (self.ranging, Var(self.ranging))], n.aggregates)
        child = self.run(n.child)
        scope = {v: column(v) for v in child.vars}
        keys = [self.term(e, scope).alias(v) for v, e in n.keys]
        aggs = [self.aggregate(a, scope, child).alias(v) for v, a in n.aggregates]
        df = child.df.groupBy(*keys).agg(*aggs) if aggs else child.df.select(*keys).distinct()
        names = [v for v, _ in n.keys] + [v for v, _ in n.aggregates]
        bound = {v for v, e in n.keys if isinstance(e, Var) and e.name in child.bound} | {v for v, a in n.aggregates if a.name == "COUNT"}
        return Relation(df, names, bound)

    def split_counts(self, n: Group) -> Relation | None:
        """COUNT(DISTINCT ?v) over unconnected OPTIONALs: a scalar aggregate a component instead of their product."""
        if self.ranging or n.keys or not n.aggregates or not all(a.name == "COUNT" and a.distinct and isinstance(a.arg, Var) for _, a in n.aggregates):
            return None
        parts, node = [], n.child
        while isinstance(node, (LeftJoin, Join)):
            if isinstance(node, LeftJoin) and node.condition is not None:
                return None
            parts.append(node.right)
            node = node.left
        parts.append(node)
        if isinstance(n.child, Join):
            return None
        parts = [p for p in parts if not (isinstance(p, BGP) and not p.patterns)]
        owners = [set(variables(p)) for p in parts]
        if len(parts) < 2 or any(owners[i] & owners[j] for i in range(len(parts)) for j in range(i)):
            return None
        if not isinstance(node, BGP) or node.patterns:  # a mandatory part can empty the whole
            return None
        out = None
        for name, a in n.aggregates:
            i = next((i for i, o in enumerate(owners) if a.arg.name in o), None)
            if i is None:
                one = self.spark.range(1).select(T.make_literal(F.lit(0), INTEGER).alias(name))
            else:
                one = self.run(parts[i]).df.agg(T.make_literal(F.count_distinct(column(a.arg.name)), INTEGER).alias(name))
            out = one if out is None else out.crossJoin(one)  # one row each
        names = [v for v, _ in n.aggregates]
        return Relation(out.select(*map(column, names)), names, set(names))

    def aggregate(self, a: Aggregate, scope: dict, child: Relation) -> Column:
        if a.name == "COUNT":
            if a.arg is None:
                n = F.count_distinct(F.struct(*[column(v) for v in child.vars])) if a.distinct else F.count(F.lit(1))
            else:
                t = self.term(a.arg, scope)
                n = F.count_distinct(t) if a.distinct else F.count(t)
            return T.make_literal(n, INTEGER)
        t = self.term(a.arg, scope)
        if a.name == "SAMPLE":
            return F.min(t)
        if a.name == "GROUP_CONCAT":
            collect = F.collect_set if a.distinct else F.collect_list
            return F.concat(F.lit('"|'), F.array_join(F.array_sort(collect(T.lexical(t))), a.separator))
        x = T.number(t)
        if a.name == "SUM":
            whole = F.min(F.coalesce((T.datatype(t) == INTEGER).cast("int"), F.lit(1)))
            total = F.coalesce(F.sum_distinct(x) if a.distinct else F.sum(x), F.lit(0.0))
            return F.when(F.coalesce(whole, F.lit(1)) == 1, T.make_literal(total.cast("bigint"), INTEGER)).otherwise(T.make_literal(total, DOUBLE))
        if a.name == "AVG":
            return T.make_literal(F.coalesce(F.avg(x), F.lit(0.0)), DOUBLE)
        best = F.max_by if a.name == "MAX" else F.min_by
        return best(t, F.struct(T.number(t), T.moment(t), T.lexical(t)))

    # Expressions
    def term(self, e: Any, scope: dict[str, Column]) -> Column:
        """An encoded term, null for unbound or an error."""
        if isinstance(e, str):
            return F.lit(e)
        if isinstance(e, Var):
            if e.name in self.bindings and e.name not in scope:
                return F.lit(self.bindings[e.name])
            return scope.get(e.name, null())
        if isinstance(e, Call):
            make = _TERMS.get(e.name)
            if make:
                return make(self, [lambda a=a: self.term(a, scope) for a in e.args], e, scope)
        return T.make_literal(self.truth(e, scope), BOOLEAN)

    def compared(self, op: str, x: Any, y: Any, scope: dict[str, Column]) -> Column:
        """A comparison; a constant side decides which kind of comparison can hold, and the rest is not compiled."""
        kind = _constant_kind(y) or _constant_kind(x)
        a, b = self.term(x, scope), self.term(y, scope)
        test = TESTS[op]
        if kind in ("number", "moment"):
            value = T.number if kind == "number" else T.moment
            same = test(value(a), value(b))
            # Terms of other kinds are unequal to a number or a time, and not in order with it.
            return F.when(value(a).isNotNull() & value(b).isNotNull(), same).when(a.isNotNull() & b.isNotNull(), F.lit(op == "!=")) if op in ("=", "!=") else same
        if kind and op in ("=", "!="):
            return test(a, b)
        if kind == "string":
            return F.when(a.startswith('"|') & b.startswith('"|'), test(a, b))
        return compare(op, a, b)

    def truth(self, e: Any, scope: dict[str, Column]) -> Column:
        """The effective boolean value, null for an error."""
        if isinstance(e, Call):
            if e.name == "||":
                return self.truth(e.args[0], scope) | self.truth(e.args[1], scope)
            if e.name == "&&":
                return self.truth(e.args[0], scope) & self.truth(e.args[1], scope)
            if e.name == "!":
                return ~self.truth(e.args[0], scope)
            if e.name in ("=", "!=", "<", ">", "<=", ">="):
                return self.compared(e.name, e.args[0], e.args[1], scope)
            if e.name in ("IN", "NOT IN"):
                hit = reduce(lambda a, b: a | b, [self.compared("=", e.args[0], y, scope) for y in e.args[1:]], F.lit(False))
                return ~hit if e.name == "NOT IN" else hit
            make = _TRUTHS.get(e.name)
            if make:
                return make(self, [self.term(a, scope) for a in e.args])
            if e.name not in _TERMS:
                raise NotImplementedError(f"function {e.name}")
        t = self.term(e, scope)
        n = T.number(t)
        yes = [T.literal(x, BOOLEAN) for x in ("true", "1")]
        plain = t.startswith('"|') | t.startswith('"@')
        return F.when(t.startswith(f'"^{BOOLEAN}|'), t.isin(*yes)).when(n.isNotNull(), n != 0).when(plain, ~t.endswith("|"))


def _constant_kind(e: Any) -> str | None:
    """What a constant term can be compared as."""
    if not isinstance(e, str):
        return None
    if e[0] != '"':
        return "term"
    tag = e[1:].partition("|")[0]
    if tag[1:] in T.NUMERIC:
        return "number"
    return "moment" if tag[1:] in (T.XSD + "dateTime", T.XSD + "date") else "string" if tag == "" else "term"


def _names(e: Any) -> set[str]:
    if isinstance(e, Var):
        return {e.name}
    return set().union(*[_names(a) for a in e.args]) if isinstance(e, Call) else set()


def _conjuncts(e: Any) -> list:
    return [x for a in e.args for x in _conjuncts(a)] if isinstance(e, Call) and e.name == "&&" else [e]


def _alternatives(e: Any) -> list:
    return [x for a in e.args for x in _alternatives(a)] if isinstance(e, Call) and e.name == "||" else [e]


def _has_exists(e: Any) -> bool:
    return isinstance(e, Exists) or isinstance(e, Call) and any(map(_has_exists, e.args))


def _components(patterns: list[Pattern]) -> list[list[Pattern]]:
    """Patterns in groups that share no variable."""
    groups: list[tuple[set[str], list[Pattern]]] = []
    for t in patterns:
        names, mine = {x.name for x in (t.s, t.p, t.o) if isinstance(x, Var)}, [t]
        for g in [g for g in groups if g[0] & names]:
            groups.remove(g)
            names, mine = names | g[0], g[1] + mine
        groups.append((names, mine))
    return [g for _, g in groups]


TESTS = {"=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}


def compare(op: str, a: Column, b: Column) -> Column:
    na, nb, ta, tb = T.number(a), T.number(b), T.moment(a), T.moment(b)
    test = TESTS[op]
    strings = a.startswith('"|') & b.startswith('"|')
    out = F.when(na.isNotNull() & nb.isNotNull(), test(na, nb)).when(ta.isNotNull() & tb.isNotNull(), test(ta, tb))
    if op in ("=", "!="):
        return F.when(a.isNotNull() & b.isNotNull(), out.otherwise(test(a, b)))
    return out.when(strings, test(a, b))


def _regex(args: list[Column]) -> Column:
    flags = "u"
    pattern = T.lexical(args[1])
    if len(args) > 2:
        # (?iu): plain (?i) misses letters outside ASCII.
        f = T.lexical(args[2])
        pattern = F.concat(F.lit("(?"), F.regexp_replace(f, "[^ismx]", ""), F.lit(flags + ")"), pattern)
    return F.call_function("rlike", T.lexical(args[0]), pattern)


_TRUTHS = {
    "BOUND": lambda c, a: a[0].isNotNull(),
    "CONTAINS": lambda c, a: T.lexical(a[0]).contains(T.lexical(a[1])),
    "STRSTARTS": lambda c, a: T.lexical(a[0]).startswith(T.lexical(a[1])),
    "STRENDS": lambda c, a: T.lexical(a[0]).endswith(T.lexical(a[1])),
    "REGEX": lambda c, a: _regex(a),
    "ISIRI": lambda c, a: a[0].startswith("<"),
    "ISURI": lambda c, a: a[0].startswith("<"),
    "ISLITERAL": lambda c, a: a[0].startswith('"'),
    "ISBLANK": lambda c, a: a[0].startswith("_"),
    "ISNUMERIC": lambda c, a: T.number(a[0]).isNotNull(),
    "SAMETERM": lambda c, a: a[0] == a[1],
    "LANGMATCHES": lambda c, a: F.when(T.lexical(a[1]) == "*", T.lexical(a[0]) != "").otherwise(F.lower(T.lexical(a[0])).startswith(F.lower(T.lexical(a[1])))),
}


def _with_text(change):
    """A string function that keeps the argument's language."""
    return lambda c, a, e, s: F.concat(F.lit('"'), F.coalesce(T.tag(a[0]()), F.lit("")), F.lit("|"), change(T.lexical(a[0]()), *[x() for x in a[1:]]))


def _plain(change):
    return lambda c, a, e, s: F.concat(F.lit('"|'), change(*[x() for x in a]))


def _numeric(op):
    def make(c, a, e, s):
        x, y = a[0](), a[1]()
        value = op(T.number(x), T.number(y))
        whole = (T.datatype(x) == INTEGER) & (T.datatype(y) == INTEGER)
        if e.name == "/":
            return T.make_literal(F.when(T.number(y) != 0, value), DECIMAL)
        return F.when(whole, T.make_literal(value.cast("bigint"), INTEGER)).otherwise(T.make_literal(value, DOUBLE))

    return make


def _one(op, integer: bool = False):
    def make(c, a, e, s):
        x = a[0]()
        v = op(T.number(x))
        return T.make_literal(v.cast("bigint"), INTEGER) if integer else F.when(T.datatype(x) == INTEGER, T.make_literal(v.cast("bigint"), INTEGER)).otherwise(T.make_literal(v, DOUBLE))

    return make


def _part(op):
    return lambda c, a, e, s: T.make_literal(op(T.moment(a[0]())), INTEGER)


def _cast(c, a, e, s):
    x, to = a[0](), e.args[1][1:]
    text = T.lexical(x)
    if to == INTEGER:
        return T.make_literal(text.try_cast("double").cast("bigint"), to)
    if to in (DECIMAL, DOUBLE, T.XSD + "float"):
        return F.when(text.try_cast("double").isNotNull(), T.make_literal(text, to))
    if to in (T.XSD + "dateTime", T.XSD + "date"):
        return F.when(F.try_to_timestamp(text).isNotNull(), T.make_literal(text, to))
    if to == BOOLEAN:
        return F.when(F.lower(text).isin("true", "false", "1", "0"), T.make_literal(F.when(F.lower(text).isin("true", "1"), "true").otherwise("false"), to))
    return T.make_literal(text, None if to == T.XSD + "string" else to)


_TERMS = {
    "STR": _plain(lambda x: T.lexical(x)),
    "LCASE": _with_text(lambda x: F.lower(x)),
    "UCASE": _with_text(lambda x: F.upper(x)),
    "STRLEN": lambda c, a, e, s: T.make_literal(F.length(T.lexical(a[0]())), INTEGER),
    "SUBSTR": lambda c, a, e, s: F.concat(
        F.lit('"'), F.coalesce(T.tag(a[0]()), F.lit("")), F.lit("|"),
        F.substring(T.lexical(a[0]()), T.number(a[1]()).cast("int"), T.number(a[2]()).cast("int") if len(a) > 2 else F.length(T.lexical(a[0]()))),
    ),
    "STRAFTER": _plain(lambda x, y: F.when(F.call_function("locate", T.lexical(y), T.lexical(x)) > 0, F.substring(T.lexical(x), F.call_function("locate", T.lexical(y), T.lexical(x)) + F.length(T.lexical(y)), F.length(T.lexical(x)))).otherwise("")),
    "STRBEFORE": _plain(lambda x, y: F.when(F.call_function("locate", T.lexical(y), T.lexical(x)) > 0, F.substring(T.lexical(x), F.lit(1), F.call_function("locate", T.lexical(y), T.lexical(x)) - 1)).otherwise("")),
    "CONCAT": _plain(lambda *x: F.concat(*[T.lexical(y) for y in x])),
    "REPLACE": lambda c, a, e, s: F.concat(F.lit('"'), F.coalesce(T.tag(a[0]()), F.lit("")), F.lit("|"), F.regexp_replace(T.lexical(a[0]()), F.concat(F.lit("(?iu)") if len(a) > 3 else F.lit("(?u)"), T.lexical(a[1]())), T.lexical(a[2]()))),
    "ENCODE_FOR_URI": _plain(lambda x: F.call_function("url_encode", T.lexical(x))),
    "LANG": _plain(lambda x: T.language(x)),
    "DATATYPE": lambda c, a, e, s: F.concat(F.lit("<"), T.datatype(a[0]())),
    "IRI": lambda c, a, e, s: F.concat(F.lit("<"), T.lexical(a[0]())),
    "URI": lambda c, a, e, s: F.concat(F.lit("<"), T.lexical(a[0]())),
    "STRDT": lambda c, a, e, s: F.concat(F.lit('"^'), T.lexical(a[1]()), F.lit("|"), T.lexical(a[0]())),
    "STRLANG": lambda c, a, e, s: F.concat(F.lit('"@'), F.lower(T.lexical(a[1]())), F.lit("|"), T.lexical(a[0]())),
    "IF": lambda c, a, e, s: F.when(c.truth(e.args[0], s), a[1]()).when(~c.truth(e.args[0], s), a[2]()),
    "COALESCE": lambda c, a, e, s: F.coalesce(*[x() for x in a]),
    "+": _numeric(lambda x, y: x + y),
    "-": _numeric(lambda x, y: x - y),
    "*": _numeric(lambda x, y: x * y),
    "/": _numeric(lambda x, y: F.try_divide(x, y)),
    "NEG": _one(lambda x: -x),
    "ABS": _one(F.abs),
    "ROUND": _one(lambda x: F.floor(x + 0.5)),
    "CEIL": _one(F.ceil),
    "FLOOR": _one(F.floor),
    "YEAR": _part(F.year),
    "MONTH": _part(F.month),
    "DAY": _part(F.dayofmonth),
    "HOURS": _part(F.hour),
    "MINUTES": _part(F.minute),
    "SECONDS": _part(F.second),
    "MD5": _plain(lambda x: F.md5(T.lexical(x))),
    "SHA1": _plain(lambda x: F.sha1(T.lexical(x))),
    "SHA256": _plain(lambda x: F.sha2(T.lexical(x), 256)),
    "CAST": _cast,
}


def select(triples: DataFrame, query: Query, bindings: dict[str, str] | None = None, quads: bool = False) -> DataFrame:
    """Encoded terms, a column a variable."""
    out = Compiler(triples, bindings, query, quads).run(query.plan)
    return out.df.select(*[column(v) for v in query.vars]) if query.vars else out.df


def ask(triples: DataFrame, query: Query, quads: bool = False) -> bool:
    return not Compiler(triples, None, query, quads).run(query.plan).df.isEmpty()


def construct(triples: DataFrame, query: Query, quads: bool = False) -> DataFrame:
    """Triples of the template; solutions that leave a part unbound give none."""
    c = Compiler(triples, None, query, quads)
    found = c.run(query.plan)
    scope = {v: column(v) for v in found.vars}
    parts = [F.struct(*[c.term(x, scope).alias(n) for n, x in zip("spo", (t.s, t.p, t.o), strict=True)]) for t in query.template]
    rows = found.df.select(F.inline(F.array(*parts))).where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL").where("NOT startswith(s, '\"') AND startswith(p, '<')")
    return decode_triples(rows)


def describe(triples: DataFrame, query: Query, quads: bool = False) -> DataFrame:
    """All triples about the named resources, in the default graph."""
    c = Compiler(triples, None, query, quads)
    triples, _ = c.source()
    wanted = [x for x in query.described if isinstance(x, str)]
    out = triples.where(F.col("s").isin([w[1:] for w in wanted])) if wanted else None
    names = [x.name for x in query.described if isinstance(x, Var)]
    if names:
        found = c.run(query.plan)
        ids = reduce(lambda a, b: a.unionByName(b), [found.df.select(T.lexical(column(v)).alias("x")) for v in names]).distinct()
        more = triples.join(ids, F.col("s") == F.col("x"), "left_semi")
        out = more if out is None else out.unionByName(more)
    return out.dropDuplicates(list(T.TRIPLE_COLUMNS))


def decode_triples(rows: DataFrame) -> DataFrame:
    kind = lambda t: F.when(t.startswith("<"), "uri").when(t.startswith("_"), "bnode").otherwise("literal")
    s, o = F.col("s"), F.col("o")
    dt = F.when(T.tag(o).startswith("^"), T.datatype(o))
    return rows.select(
        T.lexical(s).alias("s"), kind(s).alias("s_kind"), T.lexical(F.col("p")).alias("p"), T.lexical(o).alias("o"), kind(o).alias("o_kind"), dt.alias("o_dt"), F.nullif(T.language(o), F.lit("")).alias("o_lang"), F.lit("query").alias("src")
    ).dropDuplicates(list(T.TRIPLE_COLUMNS))
