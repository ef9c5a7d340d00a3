"""Plans to DataFrames, with a registry of score functions; optimisation and EXPLAIN as the caller asks for them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import PandasUDFType, pandas_udf

from engramlake.functions import expressions as x
from engramlake.operators import graph, vector
from engramlake.plans import nodes as p

HEADERS = ["node_id", "tenant", "kind", "created_at_ms", "updated_at_ms", "score", "fields"]


@dataclass(frozen=True)
class ScoreFunction:
    """A score function: a Python callable over pandas Series, one for each argument, with its signature."""

    call: Callable
    args: tuple[str, ...] = ("float",)


@dataclass
class Engine:
    """Tables and functions that plans run over.

    records: the HEADERS; embeddings: node_id, model, vector, tenant; edges: src, dst, label and what else they have.
    embed: text to vector, by model name. decay: 'score' or 'exp', see score_expr.
    """

    records: DataFrame
    embeddings: DataFrame | None = None
    edges: DataFrame | None = None
    embed: dict[str, Callable[[str], list[float]]] = field(default_factory=dict)
    now_ms: int | None = None
    decay: str = "score"
    functions: dict[str, ScoreFunction] = field(default_factory=dict)

    def register_udf(self, name: str, call: Callable, args: tuple[str, ...] = ("float",)) -> None:
        """A later registration takes the place of an earlier one of the name."""
        self.functions[name] = ScoreFunction(call, args)

    def run(self, plan: p.Plan) -> DataFrame:
        """The plan's records; nothing is computed until an action, but for the hops of a graph expansion."""
        if isinstance(plan, p.Scan):
            if plan.table != "nodes":
                raise ValueError(f"only nodes can be scanned, not {plan.table}")
            return self.records if plan.filter is None else self.records.where(x.predicate(plan.filter))
        if isinstance(plan, p.VectorSearch):
            return self._search(plan)
        if isinstance(plan, p.GraphExpand):
            return graph.expand(self.run(plan.input), self.records, self.edges, plan.relation, plan.depth)
        if isinstance(plan, p.Filter):
            return self.run(plan.input).where(x.predicate(plan.predicate))
        if isinstance(plan, p.Score):
            return self.run(plan.input).withColumn("score", x.score_expr(plan.expr, self.now_ms, self.decay).cast("float"))
        if isinstance(plan, p.TopK):
            return self.run(plan.input).orderBy(*self._order(plan.by)).limit(plan.k)
        if isinstance(plan, p.Join):
            return self._semi_join(plan)
        if isinstance(plan, p.Aggregate):
            return self._count(plan)
        if isinstance(plan, p.Project):
            return self._project(plan)
        if isinstance(plan, p.Udf):
            return self._score_function(plan)
        raise TypeError(f"unknown operator {plan!r}")

    def _search(self, plan: p.VectorSearch) -> DataFrame:
        query = plan.query
        if isinstance(query, str):
            if plan.model not in self.embed:
                raise ValueError(f"no embedder for model {plan.model}")
            query = self.embed[plan.model](query)
        pred = None if plan.filter is None else x.predicate(plan.filter)
        e = self.embeddings
        if plan.mode == "pre" and pred is not None:
            e = e.join(self.records.where(pred).select("node_id"), "node_id", "left_semi")
        hits = vector.top_k(e, query, plan.k, plan.model)
        found = self.records.drop("score").join(F.broadcast(hits.select("node_id", F.col("score").cast("float").alias("score"))), "node_id").select(*HEADERS)
        return found if pred is None or plan.mode == "pre" else found.where(pred)

    @staticmethod
    def _order(by):
        if by == "score":
            return [F.desc("score"), F.col("node_id")]
        if by == "created_at":
            return [F.desc("created_at_ms"), F.col("node_id")]
        v = x.field_value(by)
        number = F.when(v["tag"].isin("u32", "i64", "f32"), v["value"].try_cast("double"))
        rank = F.element_at(F.create_map(*[y for i, t in enumerate(p.Tag) for y in (F.lit(t.value), F.lit(i))]), v["tag"])
        if by == p.KIND:
            number = F.array_position(F.array(*[F.lit(k) for k in p.KINDS]), v["value"]).cast("double")
        return [F.asc_nulls_last(rank), F.asc_nulls_last(number), F.asc_nulls_last(v["value"]), F.col("node_id")]

    def _semi_join(self, plan: p.Join) -> DataFrame:
        left, right = self.run(plan.left), self.run(plan.right)
        if plan.on == p.NODE_ID:
            return left.join(right.select("node_id"), "node_id", "left_semi")
        key = x.field_value(plan.on)
        keys = right.select(key["tag"].alias("_t"), key["value"].alias("_v")).where("_t is not null")
        mine = left.withColumns({"_lt": key["tag"], "_lv": key["value"]})
        return mine.join(keys, (F.col("_lt") == F.col("_t")) & (F.col("_lv") == F.col("_v")), "left_semi").drop("_lt", "_lv")

    def _count(self, plan: p.Aggregate) -> DataFrame:
        rows = self.run(plan.input)
        keys = [x.field_value(f) for f in plan.group_by]
        named = {f"_k{i}": k for i, k in enumerate(keys)}
        rows = rows.withColumns(named) if named else rows
        for k in named:
            rows = rows.where(F.col(k).isNotNull())
        n = rows.groupBy(*named).agg(F.count("*").alias("_n")) if named else rows.agg(F.count("*").alias("_n")).where("_n > 0")
        label = [F.concat(F.lit(f"{f.name}="), F.col(k)["value"]) for f, k in zip(plan.group_by, named)]
        node_id = F.concat_ws("|", *label) if label else F.lit("__aggregate__")
        fields = F.map_from_arrays(F.array(*[F.lit(f.name) for f in plan.group_by]), F.array(*[F.col(k) for k in named])) if named else F.create_map().cast("map<string,struct<tag:string,value:string>>")
        zero = F.lit(0).cast("bigint")
        n = n.orderBy(*named) if named else n
        return n.select(node_id.alias("node_id"), zero.alias("tenant"), F.lit("Fact").alias("kind"), zero.alias("created_at_ms"), zero.alias("updated_at_ms"), F.col("_n").cast("float").alias("score"), fields.alias("fields"))

    def _project(self, plan: p.Project) -> DataFrame:
        rows = self.run(plan.input)
        pairs = F.array(*[F.struct(F.lit(f.name).alias("key"), x.field_value(f).alias("value")) for f in plan.fields])
        return rows.withColumn("fields", F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull())))

    def _score_function(self, plan: p.Udf) -> DataFrame:
        if plan.name not in self.functions:
            raise KeyError(f"no score function {plan.name}")
        f = self.functions[plan.name]
        args = [x.field_value(a)["value"] if isinstance(a, p.Field) else F.lit(a.value) for a in plan.args]
        types = f.args if len(f.args) == len(args) else ("string",) * len(args)
        call = f.call

        def run(*columns):
            import pandas as pd

            return pd.Series(call(*columns), dtype="float32")

        scored = pandas_udf(run, "float", PandasUDFType.SCALAR)
        return self.run(plan.input).withColumn("score", scored(*[a.cast(t) for a, t in zip(args, types)]))

    def statistics(self) -> dict[str, int]:
        """Rows by kind, for estimates."""
        return {r["kind"]: r["count"] for r in self.records.groupBy("kind").count().collect()}


# Rewrites and estimates. Catalyst plans what runs; these change or describe a plan where a caller wants it.


@dataclass(frozen=True)
class Histogram:
    """Shares of rows by literal, for selectivities; what it hasn't is judged by `other`."""

    shares: dict = field(default_factory=dict)
    other: float = 1.0

    def of(self, q: p.Predicate) -> float:
        if isinstance(q, p.And):
            out = 1.0
            for part in q.parts:
                out *= self.of(part)
            return out
        if isinstance(q, p.Or):
            out = 1.0
            for part in q.parts:
                out *= 1 - self.of(part)
            return 1 - out
        if isinstance(q, p.Not):
            return 1 - self.of(q.part)
        if isinstance(q, p.In):
            known = [self.shares[(q.field, v)] for v in q.values if (q.field, v) in self.shares]
            return min(1.0, sum(known)) if known else self.other
        if q.op == "=":
            return self.shares.get((q.field, q.value), self.other)
        return self.other


@dataclass(frozen=True)
class Statistics:
    rows: int = 0
    by_kind: dict = field(default_factory=dict)
    histogram: Histogram = Histogram()


#: Joins of one key are ordered anew from three to so many leaves.
MAX_REORDERED = 6
PUSH_BELOW = 0.5


def optimise(plan: p.Plan, stats: Statistics = Statistics(), graph_pushdown: bool = False) -> p.Plan:
    """Filters go into scans and searches, and chains of semi joins on node_id begin with the smallest right side.

    Under a search of mode 'pre' a pushed filter narrows before top-k. With graph_pushdown, a filter of selectivity up to
    PUSH_BELOW goes below a graph expansion too, which then filters seeds and not what they reach: results change.
    """
    again = lambda q: optimise(q, stats, graph_pushdown)
    if isinstance(plan, p.Filter):
        inner = again(plan.input)
        both = lambda old: plan.predicate if old is None else p.and_(old, plan.predicate)
        if isinstance(inner, p.Scan | p.VectorSearch):
            return replace(inner, filter=both(inner.filter))
        if isinstance(inner, p.GraphExpand) and graph_pushdown and stats.histogram.of(plan.predicate) <= PUSH_BELOW:
            return replace(inner, input=again(p.Filter(inner.input, plan.predicate)))
        return p.Filter(inner, plan.predicate)
    if isinstance(plan, p.Join):
        leaves, keys = _chain(plan)
        if 3 <= len(leaves) <= MAX_REORDERED and len(set(keys)) == 1:
            first, *rest = [again(q) for q in leaves]
            out = first
            for q in sorted(rest, key=lambda q: estimate(q, stats)):
                out = p.Join(out, q, keys[0])
            return out
        return replace(plan, left=again(plan.left), right=again(plan.right))
    return replace(plan, input=again(plan.input)) if hasattr(plan, "input") else plan


def _chain(plan: p.Plan) -> tuple[list[p.Plan], list[p.Field]]:
    if not isinstance(plan, p.Join):
        return [plan], []
    leaves, keys = _chain(plan.left)
    return [*leaves, plan.right], [*keys, plan.on]


def estimate(plan: p.Plan, stats: Statistics) -> int:
    """Rows that a plan is thought to give."""
    share = lambda q: 1.0 if q is None else stats.histogram.of(q)
    if isinstance(plan, p.Scan):
        return round(stats.rows * share(plan.filter))
    if isinstance(plan, p.VectorSearch):
        return min(plan.k, round(stats.rows * share(plan.filter)))
    if isinstance(plan, p.GraphExpand):
        return estimate(plan.input, stats) * (plan.depth + 1)
    if isinstance(plan, p.Filter):
        return round(estimate(plan.input, stats) * share(plan.predicate))
    if isinstance(plan, p.TopK):
        return min(plan.k, estimate(plan.input, stats))
    if isinstance(plan, p.Join):
        return min(estimate(plan.left, stats), estimate(plan.right, stats))
    return estimate(plan.input, stats)


def join_strategy(left: int | None, right: int | None) -> str:
    """The name of a join by its sides' sizes, as EXPLAIN gives it; what runs is up to Catalyst."""
    if left is None or right is None:
        return "HashBuildRight"
    few, many = min(left, right), max(left, right)
    if few * 4 <= many or few <= 128:
        return "HashBuildLeft" if left < right else "HashBuildRight"
    return "Merge" if left + right >= 1000 else "HashBuildRight"


def join_cost(sizes: list[int]) -> int:
    """Of a chain of semi joins: at each, the least size so far and the next."""
    cost, low = 0, sizes[0] if sizes else 0
    for n in sizes[1:]:
        cost += low + n
        low = min(low, n)
    return cost


_OPERATORS = {p.Scan: "ScanOp", p.VectorSearch: "VectorSearchOp", p.GraphExpand: "GraphExpandOp", p.Filter: "FilterOp", p.Score: "ScoreOp", p.TopK: "TopKOp", p.Aggregate: "AggregateOp", p.Project: "ProjectOp", p.Udf: "UdfOp"}


def explain(plan: p.Plan, stats: Statistics = Statistics(), engine: Engine | None = None) -> dict:
    """operator, estimated rows, children; and with an engine the rows each part gives, each counted by a run of its own."""
    inputs = [plan.left, plan.right] if isinstance(plan, p.Join) else [plan.input] if hasattr(plan, "input") else []
    if isinstance(plan, p.Join):
        name = join_strategy(*(estimate(q, stats) for q in inputs)) + "JoinOp"
    elif isinstance(plan, p.Scan) and plan.table != "nodes":
        name = "IndexLookupOp"
    else:
        name = _OPERATORS[type(plan)]
    out = {"operator": name, "estimated": estimate(plan, stats), "children": [explain(q, stats, engine) for q in inputs]}
    return out if engine is None else out | {"actual": engine.run(plan).count()}
