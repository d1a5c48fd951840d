"""Queries: an immutable chain of clauses, bound to parameters, compiled to one lazy DataFrame.

Clauses only describe. Binding fills parameters, the driver computes one query vector per space,
and the result is filter, score, radius, order and limit over the indexed rows, which Catalyst
runs as a scan with pushed filters under one ordered take.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tesserine.operators.index import ORIGIN, Index
from tesserine.operators.spaces import Context, NumberSpace, Space
from tesserine.schema import AnyOf, Predicate, Schema, SchemaError, with_ids
from tesserine.sources.store import write_shared


@dataclass(frozen=True, eq=False)
class Param:
    """A value that is bound when the query runs; ``options`` lists what is allowed."""

    name: str
    description: str | None = None
    default: object = None
    options: tuple | list | None = None

    def check(self, value: object) -> object:
        if self.options is not None and value is not None:
            for v in value if isinstance(value, (list, tuple, set)) else [value]:
                if v not in self.options:
                    raise SchemaError(f"{v!r} is no option of {self.name}")
        return value


@dataclass(frozen=True)
class QueryUserConfig:
    """What a query returns beside its rows; ``with_metadata`` asks for partial scores."""

    with_metadata: bool = False


#: How a comparison is called in the name that its value gets.
OPERATION_NAMES = {
    "==": "be_equal_to", "!=": "not_be_equal_to", ">": "be_greater_than", "<": "be_less_than", ">=": "be_greater_than_or_equal_to",
    "<=": "be_less_than_or_equal_to", "in": "be_in", "not_in": "not_be_in", "contains": "contain", "not_contains": "not_contain", "contains_all": "contain_all_of",
}


@dataclass(frozen=True)
class QueryPlan:
    """A bound query: everything but the rows."""

    schema: Schema
    index: Index
    parts: tuple[np.ndarray, ...]
    context: Context
    groups: tuple
    limit: int | None
    radius: float | None
    fields: tuple[str, ...]
    metadata: tuple[Space, ...]
    partial_scores: bool
    search_params: Mapping[str, object]
    strategy: str = "auto"
    origin_id: bool = False
    digits: int | None = None

    @property
    def search_vector(self) -> np.ndarray:
        return np.concatenate(self.parts)

    @property
    def least(self) -> float:
        """A score below which no row lies within the radius."""
        if not self.radius:
            return -math.inf
        return 1 - self.radius if self.digits is None else round(1 - self.radius, self.digits) - 0.5 * 10.0**-self.digits

    def frame(self, rows: DataFrame) -> DataFrame:
        """id, selected fields, score and on demand partial_scores and vector_parts; best first, ties by id."""
        from tesserine.schema import condition

        where = condition([[(p, v) for p, v in g] for g in self.groups])
        if where is not None:
            rows = rows.filter(where)
        for g in self.groups:  # one comparison of the id alone is made in the scan, too
            if len(g) == 1 and g[0][0].field.column == "id" and g[0][0].op in ("==", "in"):
                rows = with_ids(rows, [str(v) for v in ([g[0][1]] if g[0][0].op == "==" else g[0][1])])
        index, ctx = self.index, self.context
        if not any(self.schema in s.fields for s in index.spaces):  # only events give such rows a vector
            rows = rows.filter(reduce(lambda a, b: a | b, [F.col(index.raw_column(s)).isNotNull() for s in index.spaces]))
        parts = [s.score(F.col(index.raw_column(s)), q, index.scale, ctx, self.strategy) for s, q in zip(index.spaces, self.parts)]
        each = [f"__part_{i}" for i in range(len(parts))]
        keep = ["id", *self.fields]
        raws = [index.raw_column(s) for s in self.metadata]
        origin = [ORIGIN] if self.origin_id and ORIGIN in rows.columns else []
        scored = rows.select(*keep, *origin, *[c for c in dict.fromkeys(raws)], *[p.alias(n) for p, n in zip(parts, each)])
        total = F.lit(0.0)
        for n in each:
            total = total + F.col(n)
        scored = scored.withColumn("score", total)
        if self.radius and self.digits is None:
            scored = scored.filter(F.col("score") >= 1 - self.radius)
        elif self.radius:
            scored = scored.filter(F.round("score", self.digits) >= round(1 - self.radius, self.digits))
        scored = scored.orderBy(F.desc(F.round("score", 12)), F.asc("id"))
        if self.limit and self.limit > 0:
            scored = scored.limit(self.limit)
        out = [F.coalesce(ORIGIN, "id").alias("id") if origin else "id", *self.fields, "score"]
        extra = []
        if self.partial_scores:
            extra.append(F.array(*each).alias("partial_scores"))
        if self.metadata:
            extra.append(F.array(*[index.stored_part(s, ctx) for s in self.metadata]).alias("vector_parts"))
        return scored.select(*out, *extra)


@dataclass(frozen=True, eq=False)
class Query:
    """``Query(index).find(schema)`` and then clauses; every call returns a new query."""

    index: Index
    weights: dict | None = None
    schema: Schema | None = None
    similars: tuple = ()
    look: tuple | None = None
    filters: tuple = ()
    radius_: object = None
    digits: int | None = None
    limit_: object = None
    selected: object = None
    metadata_: tuple = ()
    now_: object = None
    natural: tuple | None = None
    partial: bool = False
    once: frozenset = field(default=frozenset())

    def _one(self, clause: str, **changes) -> Query:
        if clause in self.once:
            raise SchemaError(f"a query has one {clause}")
        return replace(self, once=self.once | {clause}, **changes)

    def _found(self) -> Schema:
        if self.schema is None:
            raise SchemaError("find a schema first")
        return self.schema

    def find(self, schema: Schema) -> Query:
        if schema not in self.index.schemas and not any(e.affected_reference.target is type(schema) for e in self.index.effects):
            raise SchemaError(f"{schema.schema_name} is not in the index")
        return self._one("find", schema=schema)

    def similar(self, space: Space, value: object, weight: object = 1.0) -> Query:
        self.index.position(space)
        if not space.similar_allowed:
            raise SchemaError(f"{space.name} takes no similar clause")
        if self._found() not in space.fields and not self.index.effects:
            raise SchemaError(f"{self.schema.schema_name} is not in {space.name}")
        return replace(self, similars=(*self.similars, (space, value, weight)))

    def with_vector(self, schema: Schema, entity_id: object, weight: object = 1.0) -> Query:
        """Like a stored entity; ``weight`` is a number or one per space (1 for those left out)."""
        if schema not in self.index.schemas:
            raise SchemaError(f"{schema.schema_name} is not in the index")
        return self._one("with_vector", look=(schema, entity_id, weight))

    def space_weights(self, weights: dict) -> Query:
        known = {id(s) for s in self.weights or {}}
        for s in weights:
            self.index.position(s)
            if id(s) in known:
                raise SchemaError(f"{s.name} has a weight already")
        return replace(self, weights={**(self.weights or {}), **weights})

    def filter(self, predicate: Predicate | AnyOf) -> Query:
        for p in predicate.members:
            if p.field.schema is not self._found():
                raise SchemaError(f"{p.field.name} is no field of {self.schema.schema_name}")
            if p.field.column != "id" and not any(p.field is f for f in self.index.fields):
                raise SchemaError(f"{p.field.name} is not among the index's fields")
        return replace(self, filters=(*self.filters, predicate))

    def radius(self, radius: object, digits: int | None = None) -> Query:
        """Rows whose score is at least ``1 - radius``; with ``digits`` the score counts as it is shown, rounded to so many."""
        return self._one("radius", radius_=radius, digits=digits)

    def limit(self, limit: object) -> Query:
        return self._one("limit", limit_=limit)

    def select(self, *fields, metadata: list[Space] | None = None) -> Query:
        chosen = fields[0] if len(fields) == 1 and isinstance(fields[0], (list, tuple, Param)) else list(fields)
        for s in metadata or []:
            self.index.position(s)
        if not isinstance(chosen, Param):
            self._names(chosen)
        return self._one("select", selected=chosen, metadata_=tuple(sorted(metadata or [], key=self.index.position)))

    def select_all(self, metadata: list[Space] | None = None) -> Query:
        return self.select([f.name for f in self.index.kept_fields(self._found())], metadata=metadata)

    def _names(self, chosen) -> list[str]:
        allowed = {f.name: f.column for f in self.index.kept_fields(self._found())}
        names = [f if isinstance(f, str) else f.name for f in chosen or []]
        wrong = [n for n in names if n not in allowed and n != self.schema.id_field.name]
        if wrong:
            raise SchemaError(f"{self.schema.schema_name} has no {wrong} to select")
        return [allowed[n] for n in dict.fromkeys(names) if n in allowed]

    def override_now(self, now: object) -> Query:
        return self._one("override_now", now_=now)

    def include_metadata(self) -> Query:
        return self.replace_user_config(QueryUserConfig(with_metadata=True))

    def replace_user_config(self, config: QueryUserConfig) -> Query:
        return replace(self, partial=config.with_metadata)

    def with_natural_query(self, text: object, filler) -> Query:
        """Unset parameters are filled from ``text`` by ``filler`` (see ``tesserine.plans.natural``)."""
        return self._one("with_natural_query", natural=(text, filler))

    def params(self) -> dict[str, Param]:
        """All parameters by name."""
        out: dict[str, Param] = {}

        def see(x):
            if isinstance(x, Param):
                out[x.name] = x
            elif isinstance(x, dict):
                [see(v) for v in x.values()]
            elif isinstance(x, (list, tuple)):
                [see(v) for v in x]

        see([self.weights or {}, [s[1:] for s in self.similars], (self.look or ())[1:], [[p.value for p in f.members] for f in self.filters], self.radius_, self.limit_, self.selected, self.now_, (self.natural or ())[:1]])
        return out

    def bind(self, values: Mapping[str, object], stored: Callable[[Schema, str], Mapping[str, object]], now: int = 0, strategy: str = "auto") -> QueryPlan:
        """Fill parameters (given, natural language, defaults, weight rule) and compute the query vectors.

        ``stored(schema, id)`` gives the raw values of an indexed row.
        """
        schema, params = self._found(), self.params()
        unknown = set(values) - set(params)
        if unknown:
            raise SchemaError(f"the query has no parameters {sorted(unknown)}")
        bound = {n: p.check(values[n]) for n, p in params.items() if n in values}
        if self.natural and (text := bound.get(self.natural[0].name) if isinstance(self.natural[0], Param) else self.natural[0]):
            bound |= {n: params[n].check(v) for n, v in self.natural[1].fill(text, [p for n, p in params.items() if n not in bound]).items()}
        bound = {n: bound.get(n, p.default) for n, p in params.items()}
        get = lambda x: bound[x.name] if isinstance(x, Param) else x

        ctx = Context(int(get(self.now_) if get(self.now_) is not None else now))
        inputs: dict[int, list] = {i: [] for i in range(len(self.index.spaces))}
        for space, value, weight in self.similars:
            v, w = get(value), get(weight)
            if v is not None and w:
                inputs[self.index.position(space)].append((v, float(w)))
        items: dict[int, list] = {i: [] for i in inputs}
        if self.look:
            of, entity, weight = self.look
            entity, weight = get(entity), get(weight)
            each = {i: float(get(next((w for s, w in weight.items() if s is sp), 1.0)) or 0) for i, sp in enumerate(self.index.spaces)} if isinstance(weight, dict) else {i: float(weight or 0) for i in inputs}
            if entity is not None and any(each.values()):
                raw = stored(of, str(entity))
                for i, s in enumerate(self.index.spaces):
                    if each[i] or isinstance(s, NumberSpace):
                        items[i].append((raw[self.index.raw_column(s)], each[i]))

        weights, search = [], {}
        for i, s in enumerate(self.index.spaces):
            w = get(next((w for k, w in (self.weights or {}).items() if k is s), None))
            used = bool(inputs[i]) or any(x[1] for x in items[i])
            weights.append(float(w) if w is not None else 1.0 if used else 0.0)
            search[f"space_weight_{s.name}_param__"] = weights[-1]
        parts = query_parts(self.index, inputs, items, weights, ctx)

        groups = []
        for n, f in enumerate(self.filters):
            members = []
            for p in f.members:
                v = get(p.value)
                if v is None and isinstance(p.value, Param):
                    continue  # an unbound parameter leaves its filter out
                members.append((p, v))
                name = p.value.name if isinstance(p.value, Param) else f"hard_filter_{p.field.name}_{OPERATION_NAMES[p.op]}_param__"
                search[name if name not in search else f"{name}{n}__"] = v
            groups.append(tuple(members))
        limit, radius, chosen = get(self.limit_), get(self.radius_), get(self.selected)
        if limit is not None and (isinstance(limit, bool) or not isinstance(limit, int)):
            raise SchemaError("a limit is a whole number")
        if radius is not None and not (isinstance(radius, (int, float)) and 0 <= radius <= 1):
            raise SchemaError("a radius lies between 0 and 1")
        search |= {"limit_param__": limit, "radius_param__": radius, **bound}
        return QueryPlan(schema, self.index, tuple(parts), ctx, tuple(groups), limit, radius, tuple(self._names(chosen)), self.metadata_, self.partial, search, strategy, digits=self.digits)


def query_parts(index: Index, inputs: dict[int, list], items: dict[int, list], weights: list[float], ctx: Context) -> list[np.ndarray]:
    """The parts of the query vector: weighted, over the length of the active weights, and made up for unused spaces."""
    parts = [s.query(inputs[i], items[i], ctx) for i, s in enumerate(index.spaces)]
    if len(parts) == 1:
        return parts
    active = [bool(np.any(q)) for q in parts]
    norm = math.sqrt(sum(w * w for w, a in zip(weights, active) if a)) or 1.0
    used = sum(a and w != 0 for w, a in zip(weights, active)) or 1
    by = math.sqrt(len(parts) / used) / norm
    return [np.zeros(len(q)) if not w else np.where(s.masked(), q, q * w * by) for s, q, w in zip(index.spaces, parts, weights)]


#: Query vectors of a block, bytes of row vectors of a block, and the rows below which a block is not split to make tasks.
QUERY_BLOCK = 16384
ROW_BLOCK_BYTES = 16 << 20
LEAST_ROWS = 1024
#: Queries and rows whose scores a task has at one time, and pairs whose vectors meet in double precision at one time.
TILE_QUERIES, TILE_ROWS, PAIRS = 1024, 4096, 1 << 14


def kth_largest(s: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th largest number of each row; nothing below it where there are no more than ``k``."""
    return np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] > k else np.full(len(s), -np.inf)


def pair_scores(m: np.ndarray, v: np.ndarray, q: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Inner products of rows ``q`` of ``m`` with rows ``row`` of ``v``, at nine digits."""
    out = np.empty(len(q))
    for at in range(0, len(q), PAIRS):
        out[at : at + PAIRS] = np.einsum("ij,ij->i", m[q[at : at + PAIRS]], v[row[at : at + PAIRS]])
    return np.round(out, 9)


def block_top_k(asked: pa.Table, some: pa.Table, length: int, k: int, scores: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, row_length: int | None = None) -> pa.Table:
    """Best ``k`` rows of one block (id, v) for each query (q, v) of another: query_id, id, score.

    Inner products are made in single precision first. What they can be off by is known, so that only pairs
    that may be among the best are computed in double precision, and the result is that of doubles.
    """

    def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
        return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)

    m, width = matrix(asked["v"], length), row_length or length
    place = np.empty(some.num_rows, np.int64)  # of each row in the order of ids
    place[np.argsort(np.array(some["id"].to_pylist(), dtype=str), kind="stable")] = np.arange(some.num_rows)
    tiles = [slice(at, at + TILE_QUERIES) for at in range(0, len(m), TILE_QUERIES)]
    best = [(np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)) for _ in tiles]  # query in its tile, score, row
    floors = [np.full(len(m[t]), -np.inf) for t in tiles]  # the k-th best scores so far
    with np.errstate(over="ignore", invalid="ignore"):
        small, norms = m.astype(np.float32), np.linalg.norm(m, axis=1)
    for at in range(0, some.num_rows if len(m) else 0, TILE_ROWS):
        v = matrix(some["v"].slice(at, TILE_ROWS), width)
        longest = 0.0
        if scores is None:
            with np.errstate(over="ignore", invalid="ignore"):
                few, longest = v.astype(np.float32), np.linalg.norm(v, axis=1).max()
        for i, t in enumerate(tiles):
            floor = floors[i]
            if scores is None and longest < 1e15 and norms[t].max() < 1e15:
                s = small[t] @ few.T
                off = (length + 4) * 2.0**-23 * norms[t] * longest + 1e-9  # sums of rounded products, and the nine digits
            else:
                s, off = np.round(scores(m[t], v) if scores else m[t] @ v.T, 9), None
            least = floor if off is None else floor - off
            if (floor == -np.inf).any():
                first = kth_largest(s, k)
                least = np.maximum(least, first if off is None else first - 2 * off)
            if off is not None:  # the next smaller single, so that the comparison stays in singles
                least = np.nextafter(least.astype(np.float32), np.float32(-np.inf))
            q, row = np.nonzero(s >= least[:, None])
            if len(q) > 16 * k * len(floor) and s.shape[1] > k:  # rows that get better and better
                first = kth_largest(s, k)
                q, row = np.nonzero(s >= np.maximum(least, first if off is None else np.nextafter((first - 2 * off).astype(np.float32), np.float32(-np.inf)))[:, None])
            if not len(q):
                continue
            new = pair_scores(m[t], v, q, row) if off is not None else s[q, row]
            of, score, row = (np.concatenate(x) for x in zip(best[i], (q, new, row + at)))
            order = np.lexsort((place[row], -score, of))
            of, score, row = of[order], score[order], row[order]
            rank = np.arange(len(of)) - np.searchsorted(of, of)
            floor[of[rank == k - 1]] = score[rank == k - 1]
            best[i] = of[rank < k], score[rank < k], row[rank < k]
    of, score, row = (np.concatenate([np.empty(0, kind), *x]) for kind, x in zip((np.int64, float, np.int64), zip(*[(b[0] + t.start, b[1], b[2]) for b, t in zip(best, tiles)]))) if tiles else (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))
    return pa.table([asked["q"].combine_chunks().take(pa.array(of)), some["id"].combine_chunks().take(pa.array(row)).cast(pa.string()), pa.array(score)], names=["query_id", "id", "score"])


def batch_top_k(
    rows: DataFrame, queries: DataFrame, length: int, k: int, id_col: str = "id", vector_col: str = "vector", query_id: str = "query_id", query_vector: str = "query",
    scores: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, row_length: int | None = None,
) -> DataFrame:
    """Exact top ``k`` rows for each of many query vectors: query_id, id, score, rank (ties by id).

    Rows and queries are written once and dealt into blocks of bounded size by their hash; Spark
    brings every block of queries together with every block of rows, and only the best ``k`` per
    query leave a pair of blocks. No vector passes through the driver. The shuffle carries the rows
    once per block of queries and the queries once per block of rows. Rows and queries with null
    vectors are left out.

    ``scores`` takes a matrix of queries and one of rows (arrays of ``row_length`` numbers, kept in their
    type) and gives the scores in place of inner products.
    """
    schema = T.StructType([T.StructField("query_id", queries.schema[query_id].dataType), T.StructField("id", T.StringType()), T.StructField("score", T.DoubleType())])
    given = write_shared(queries.select(F.col(query_id).alias("q"), F.col(query_vector).cast("array<double>").alias("v")).filter("v is not null"))
    stored = F.col(vector_col) if scores else F.col(vector_col).cast("array<double>")
    vectors = write_shared(rows.select(F.col(id_col).cast("string").alias("id"), stored.alias("v")).filter("v is not null"))
    n, tasks = vectors.count(), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-given.count() // QUERY_BLOCK))
    groups = max(1, -(-n * 8 * length // ROW_BLOCK_BYTES), min(-(-tasks // blocks), -(-n // LEAST_ROWS)))

    def dealt(df: DataFrame, key: str, own: str, mine: int, other: str, others: int):
        """Each row in its own block, once per block of the other side."""
        block = F.pmod(F.xxhash64(key, "v"), F.lit(mine)).cast("int")
        return df.withColumn(own, block).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))).groupBy("b", "g")

    def best_of(asked: pa.Table, some: pa.Table) -> pa.Table:
        return block_top_k(asked, some, length, k, scores, row_length)

    local = dealt(given, "q", "b", blocks, "g", groups).cogroup(dealt(vectors, "id", "g", groups, "b", blocks)).applyInArrow(best_of, schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return local.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)
