"""The plan language: field references, tagged literals, predicates, score expressions and ten plan operators."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

KINDS = ("Episode", "Fact", "Entity", "Artifact")


@dataclass(frozen=True)
class Field:
    """A header column (tenant, kind, created_at, updated_at, score, node_id), content, or a metadata key."""

    name: str
    metadata: bool = False


TENANT, KIND, CREATED_AT, UPDATED_AT = Field("tenant"), Field("kind"), Field("created_at"), Field("updated_at")
CONTENT, SCORE, NODE_ID = Field("content"), Field("score"), Field("node_id")


def metadata(key: str) -> Field:
    return Field(key, True)


class Tag(str, Enum):
    """Type of a literal; literals of different types are never equal."""

    U32, I64, F32, STRING, KIND, KINDS, BOOL = "u32", "i64", "f32", "string", "kind", "kinds", "bool"


@dataclass(frozen=True)
class Literal:
    tag: Tag
    value: object


def u32(v: int) -> Literal:
    return Literal(Tag.U32, v)


def i64(v: int) -> Literal:
    return Literal(Tag.I64, v)


def f32(v: float) -> Literal:
    return Literal(Tag.F32, v)


def string(v: str) -> Literal:
    return Literal(Tag.STRING, v)


def boolean(v: bool) -> Literal:
    return Literal(Tag.BOOL, v)


def kind(v: str) -> Literal:
    return Literal(Tag.KIND, v)


class Predicate:
    def __and__(self, other: Predicate) -> Predicate:
        return and_(self, other)


@dataclass(frozen=True)
class Compare(Predicate):
    """op: =, >, >=, < or <=."""

    op: str
    field: Field
    value: Literal


@dataclass(frozen=True)
class In(Predicate):
    field: Field
    values: tuple[Literal, ...]


@dataclass(frozen=True)
class And(Predicate):
    parts: tuple[Predicate, ...]


@dataclass(frozen=True)
class Or(Predicate):
    parts: tuple[Predicate, ...]


@dataclass(frozen=True)
class Not(Predicate):
    part: Predicate


def and_(*parts: Predicate) -> Predicate:
    """A conjunction, with conjunctions inside it flattened; one part is itself."""
    flat = tuple(q for p in parts for q in (p.parts if isinstance(p, And) else (p,)))
    return flat[0] if len(flat) == 1 else And(flat)


def eq(field: Field, value: Literal) -> Predicate:
    return Compare("=", field, value)


def kind_eq(name: str) -> Predicate:
    return eq(KIND, kind(name))


def kind_in(*names: str) -> Predicate:
    return In(KIND, tuple(kind(n) for n in names))


def created_after(ms: int) -> Predicate:
    """Strictly later."""
    return Compare(">", CREATED_AT, i64(ms))


class ScoreExpr:
    pass


@dataclass(frozen=True)
class Similarity(ScoreExpr):
    pass


@dataclass(frozen=True)
class Decay(ScoreExpr):
    field: Field
    half_life_ms: int


@dataclass(frozen=True)
class Number(ScoreExpr):
    value: float


@dataclass(frozen=True)
class Add(ScoreExpr):
    left: ScoreExpr
    right: ScoreExpr


@dataclass(frozen=True)
class Mul(ScoreExpr):
    left: ScoreExpr
    right: ScoreExpr


class Plan:
    pass


@dataclass(frozen=True)
class Scan(Plan):
    table: str = "nodes"
    filter: Predicate | None = None


@dataclass(frozen=True)
class VectorSearch(Plan):
    """query: a vector (tuple of floats) or a text. mode: whether the filter comes after top-k, or before."""

    query: tuple[float, ...] | str
    k: int
    filter: Predicate | None = None
    model: str = "text"
    mode: str = "post"


@dataclass(frozen=True)
class GraphExpand(Plan):
    input: Plan
    relation: str | None
    depth: int


@dataclass(frozen=True)
class Filter(Plan):
    input: Plan
    predicate: Predicate


@dataclass(frozen=True)
class Score(Plan):
    input: Plan
    expr: ScoreExpr


@dataclass(frozen=True)
class TopK(Plan):
    """by: 'score' and 'created_at' descend; a Field ascends, missing last."""

    input: Plan
    k: int
    by: str | Field = "score"


@dataclass(frozen=True)
class Join(Plan):
    """Left rows whose key is among the right ones; on is NODE_ID or another field."""

    left: Plan
    right: Plan
    on: Field = NODE_ID


@dataclass(frozen=True)
class Aggregate(Plan):
    """Counts by fields."""

    input: Plan
    group_by: tuple[Field, ...] = ()


@dataclass(frozen=True)
class Project(Plan):
    input: Plan
    fields: tuple[Field, ...]


@dataclass(frozen=True)
class Udf(Plan):
    input: Plan
    name: str
    args: tuple[Field | Literal, ...] = (SCORE,)


class Query:
    """Fluent plans: Query.recall().filter(...).similar_to(...).using_model(...).topk(20).limit(5).build()."""

    def __init__(self):
        self._filter, self._query, self._model, self._k, self._limit, self._by = None, None, "text", 10, None, None

    @classmethod
    def recall(cls) -> Query:
        return cls()

    def filter(self, predicate: Predicate) -> Query:
        self._filter = predicate if self._filter is None else and_(self._filter, predicate)
        return self

    def similar_to(self, query) -> Query:
        self._query = query if isinstance(query, str) else tuple(float(x) for x in query)
        return self

    def using_model(self, model: str) -> Query:
        self._model = model
        return self

    def topk(self, k: int) -> Query:
        self._k = k
        return self

    def limit(self, n: int) -> Query:
        self._limit = n
        return self

    def build(self) -> Plan:
        """Newest first for a scan, best score first for a search."""
        if self._query is None:
            plan: Plan = Scan("nodes", self._filter)
            return plan if self._limit is None else TopK(plan, self._limit, "created_at")
        plan = VectorSearch(self._query, self._k, self._filter, self._model)
        return plan if self._limit is None else TopK(plan, self._limit, "score")
