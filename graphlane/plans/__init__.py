"""Execution policies: eight variants, what they need, and drivers that run vertex programs under them."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from enum import Enum
from typing import Any, Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlane.functions import stored
from graphlane.graph import Graph


class ExecutionMode(Enum):
    SYNC = 0
    ASYNC = 1


class MessagePassing(Enum):
    PUSH = 0
    PULL = 1


class SchedulingMode(Enum):
    DD = 0  # data-driven: from the frontier
    TD = 1  # topology-driven: over all vertices, those that the program calls active


@dataclass(frozen=True)
class Variant:
    mode: ExecutionMode
    messages: MessagePassing
    scheduling: SchedulingMode

    def _key(self) -> tuple[int, int, int]:
        return self.mode.value, self.messages.value, self.scheduling.value

    def __lt__(self, other: Variant) -> bool:
        return self._key() < other._key()

    def __str__(self) -> str:
        return f"{self.mode.name}_{self.messages.name}_{self.scheduling.name}"

    is_synchronous = property(lambda self: self.mode is ExecutionMode.SYNC)
    is_asynchronous = property(lambda self: self.mode is ExecutionMode.ASYNC)
    is_push = property(lambda self: self.messages is MessagePassing.PUSH)
    is_pull = property(lambda self: self.messages is MessagePassing.PULL)
    is_data_driven = property(lambda self: self.scheduling is SchedulingMode.DD)
    is_topology_driven = property(lambda self: self.scheduling is SchedulingMode.TD)

    @staticmethod
    def all() -> tuple[Variant, ...]:
        return tuple(Variant(a, b, c) for a in ExecutionMode for b in MessagePassing for c in SchedulingMode)

    @staticmethod
    def from_string(name: str) -> Variant:
        if (v := Registry.find(name)) is None:
            raise ValueError(f"no such variant: {name!r}")
        return v


class Registry:
    """All variants in their order; lookups don't raise, but at() does."""

    @staticmethod
    def all() -> tuple[Variant, ...]:
        return Variant.all()

    @staticmethod
    def size() -> int:
        return len(Variant.all())

    @staticmethod
    def at(i: int) -> Variant:
        if not 0 <= i < Registry.size():
            raise IndexError("no such variant")
        return Variant.all()[i]

    @staticmethod
    def find(name: str) -> Variant | None:
        return {str(v): v for v in Variant.all()}.get(name)

    @staticmethod
    def contains(v: Variant | str) -> bool:
        return Registry.find(str(v)) is not None


@dataclass(frozen=True)
class ExecutionConfig:
    variant: Variant = Variant(ExecutionMode.SYNC, MessagePassing.PUSH, SchedulingMode.DD)

    def with_variant(self, v: Variant) -> ExecutionConfig:
        return replace(self, variant=v)

    def with_mode(self, m: ExecutionMode) -> ExecutionConfig:
        return replace(self, variant=replace(self.variant, mode=m))

    def with_messages(self, m: MessagePassing) -> ExecutionConfig:
        return replace(self, variant=replace(self.variant, messages=m))

    def with_scheduling(self, s: SchedulingMode) -> ExecutionConfig:
        return replace(self, variant=replace(self.variant, scheduling=s))

    def __str__(self) -> str:
        return str(self.variant)

    @staticmethod
    def from_string(name: str) -> ExecutionConfig:
        return ExecutionConfig(Variant.from_string(name))


class Frontier:
    """Active vertices between supersteps: a DataFrame of v in which repeats may stand until distinct() is asked for."""

    is_deterministic = False

    def __init__(self, spark: SparkSession, rows: DataFrame | None = None) -> None:
        self.spark = spark
        self.rows = rows.select("v") if rows is not None else spark.createDataFrame([], "v long")

    def clear(self) -> None:
        self.rows = self.spark.createDataFrame([], "v long")

    def push(self, v: int | Iterable[int]) -> None:
        own = [v] if isinstance(v, int) else list(v)
        self.rows = self.rows.union(self.spark.createDataFrame([(x,) for x in own], "v long"))

    def pop(self) -> int | None:
        """Takes out one occurrence of the least vertex."""
        r = self.rows.agg(F.min("v")).first()[0]
        if r is not None:
            self.rows = self.rows.exceptAll(self.spark.createDataFrame([(r,)], "v long"))
        return r

    def size(self) -> int:
        return self.rows.count()

    def empty(self) -> bool:
        return not self.rows.limit(1).count()

    def distinct(self) -> DataFrame:
        return self.rows.distinct()


@dataclass(frozen=True)
class FrontierView:
    """A frontier or none: none is empty."""

    frontier: Frontier | None = None

    def valid(self) -> bool:
        return self.frontier is not None

    def size(self) -> int:
        return self.frontier.size() if self.frontier else 0

    def empty(self) -> bool:
        return self.frontier is None or self.frontier.empty()


class FrontierAdapter:
    """Any object with clear, push, pop, size and empty, as a frontier."""

    def __init__(self, underlying: Any) -> None:
        self.underlying = underlying

    def __getattr__(self, name: str) -> Any:
        return getattr(self.underlying, name)

    @property
    def is_deterministic(self) -> bool:
        return bool(getattr(self.underlying, "is_deterministic", False))


@dataclass
class Context:
    graph: Graph | None = None
    activity: Any = None
    partitions: DataFrame | None = None
    tasks: DataFrame | None = None
    frontier: Frontier | None = None

    def has(self, what: str) -> bool:
        return getattr(self, what) is not None

    def satisfies(self, variant: Variant) -> bool:
        return is_valid_configuration(self, variant)


def requires_frontier(v: Variant) -> bool:
    return v.is_data_driven


def is_valid_variant(v: Variant) -> bool:
    return isinstance(v, Variant) and Registry.contains(v)


def is_valid_configuration(context: Context, v: Variant) -> bool:
    """There is a graph and, if the variant starts from a frontier, a frontier."""
    return context.graph is not None and (context.frontier is not None or not requires_frontier(v))


@dataclass(frozen=True)
class ExecutionPlan:
    config: ExecutionConfig

    @property
    def variant(self) -> Variant:
        return self.config.variant

    @property
    def requires_frontier(self) -> bool:
        return requires_frontier(self.variant)

    def is_compatible_with(self, context: Context) -> bool:
        return is_valid_configuration(context, self.variant)

    def __str__(self) -> str:
        return str(self.variant)


def select(what: Variant | ExecutionConfig | str | None = None) -> ExecutionPlan:
    """A plan from a variant, a config, a name, or by default."""
    if isinstance(what, str):
        what = Variant.from_string(what)
    return ExecutionPlan(what if isinstance(what, ExecutionConfig) else ExecutionConfig(what) if what else ExecutionConfig())


def can_select(name: str) -> bool:
    return Registry.contains(name)


class Status(Enum):
    SUCCESS = 0
    NOT_INITIALIZED = 1
    INVALID_CONFIGURATION = 2
    INVALID_CONTEXT = 3
    NO_WORK = 4
    CONVERGED = 5


@dataclass(frozen=True)
class StepResult:
    status: Status
    processed: int = 0
    activated: int = 0

    @property
    def succeeded(self) -> bool:
        return self.status in (Status.SUCCESS, Status.CONVERGED)

    @property
    def has_work(self) -> bool:
        return self.processed > 0 or self.activated > 0

    @property
    def reached_convergence(self) -> bool:
        return self.status is Status.CONVERGED


@runtime_checkable
class VertexProgram(Protocol):
    """Hooks return columns over value, buffer, weight and src_value, src_buffer, src_deg, so that all of a superstep is one plan."""

    needs_weights: bool

    def init_value(self, v: Column) -> Column: ...
    def init_buffer(self, v: Column) -> Column: ...
    def identity(self) -> Column: ...
    def message(self, weight: Column) -> Column: ...
    def reduce(self, message: Column) -> Column: ...
    def combine(self, value: Column, buffer: Column, message: Column) -> tuple[Column, Column, Column]:
        """New value, new buffer, whether the vertex becomes active."""
        ...


class Program:
    """Defaults of a vertex program."""

    needs_weights = False
    keeps_work = False  # a vertex that gets nothing new may still have work of its own
    supports_activity = True
    variant: Variant | None = None

    def init_buffer(self, v: Column) -> Column:
        return F.lit(0.0)

    def is_active(self, value: Column, buffer: Column) -> Column:
        return F.lit(True)

    def is_high_priority(self, value: Column, buffer: Column) -> Column:
        return F.lit(True)

    def post(self, value: Column, buffer: Column, was_active: Column) -> tuple[Column, Column]:
        return value, buffer

    def message(self, weight: Column) -> Column:
        raise NotImplementedError("the program has no message over weighted edges" if self.needs_weights else "the program has no message")


class ShortestPaths(Program):
    """Value: distance. A fixed point in any order."""

    needs_weights = True

    def __init__(self, source: int = 0) -> None:
        self.source = source

    def init_value(self, v: Column) -> Column:
        return F.when(v == self.source, 0.0).otherwise(float("inf"))

    def identity(self) -> Column:
        return F.lit(float("inf"))

    def message(self, weight: Column) -> Column:
        return F.col("src_value") + weight

    def reduce(self, message: Column) -> Column:
        return F.min(message)

    def combine(self, value: Column, buffer: Column, message: Column) -> tuple[Column, Column, Column]:
        return F.least(value, message), buffer, message < value

    def is_active(self, value: Column, buffer: Column) -> Column:
        return value < float("inf")


class DeltaPageRank(Program):
    """Value: rank so far; buffer: what arrived and isn't passed on yet. Dangling vertices keep what they get."""

    keeps_work = True

    def __init__(self, n: int, damping: float = 0.85, tolerance: float = 1e-9) -> None:
        self.n, self.damping, self.tolerance = n, damping, tolerance

    def init_value(self, v: Column) -> Column:
        return F.lit((1 - self.damping) / self.n)

    def init_buffer(self, v: Column) -> Column:
        return F.lit((1 - self.damping) / self.n)

    def identity(self) -> Column:
        return F.lit(0.0)

    def message(self, weight: Column) -> Column:
        return F.lit(self.damping) * F.col("src_buffer") / F.col("src_deg")

    def reduce(self, message: Column) -> Column:
        return F.sum(message)

    def combine(self, value: Column, buffer: Column, message: Column) -> tuple[Column, Column, Column]:
        return value + message, buffer + message, buffer + message > self.tolerance

    def is_active(self, value: Column, buffer: Column) -> Column:
        return buffer > self.tolerance

    def post(self, value: Column, buffer: Column, was_active: Column) -> tuple[Column, Column]:
        return value, F.when(was_active, 0.0).otherwise(buffer)


class ProgramAdapter:
    """Forwards to a program it doesn't own."""

    def __init__(self, underlying: Any) -> None:
        self.underlying = underlying

    def __getattr__(self, name: str) -> Any:
        return getattr(self.underlying, name)


def is_program(x: Any) -> bool:
    """Whether x, or the class x, has all hooks of a vertex program."""
    hooks = ("init_value", "init_buffer", "identity", "message", "reduce", "combine")
    return hasattr(x, "needs_weights") and all(callable(getattr(x, h, None)) for h in hooks)


@dataclass(frozen=True)
class Traits:
    """What a program or its class is known for."""

    requires_edge_weights: bool
    supports_activity: bool

    @staticmethod
    def of(program: Any) -> Traits:
        if not is_program(program):
            raise TypeError("not a vertex program")
        return Traits(bool(program.needs_weights), bool(getattr(program, "supports_activity", False)))


class DeferredDriver:
    """Stands for a driver that is chosen later: it takes a program of its variant, but never runs a step."""

    def __init__(self, plan: ExecutionPlan) -> None:
        self.plan, self.initialized, self.context = plan, False, None

    @property
    def variant(self) -> Variant:
        return self.plan.variant

    def initialize(self, program: Any, config: ExecutionConfig | None = None) -> bool:
        self.initialized = (config or self.plan.config).variant == self.plan.variant
        return self.initialized

    def set_context(self, context: Context) -> None:
        self.context = context

    def execute_step(self) -> StepResult:
        return StepResult(Status.INVALID_CONFIGURATION if self.initialized else Status.NOT_INITIALIZED)


class SuperstepDriver:
    """Runs a program on a graph, superstep by superstep, each written to the shared folder.

    PUSH starts from the active vertices and joins their edges; PULL starts from the edges by destination and looks up
    the states of sources. DD takes the frontier of the step before, TD asks the program over all vertices. ASYNC lets
    `hops` steps see one another's updates before the barrier; SYNC one.
    """

    hops = 3

    def __init__(self, plan: ExecutionPlan) -> None:
        self.plan = plan
        self.finalize()

    def finalize(self) -> None:
        self.program: Any = None
        self.config: ExecutionConfig | None = None
        self.context: Context | None = None
        self.state: DataFrame | None = None
        self.initialized = self.converged = False

    @property
    def variant(self) -> Variant:
        return self.plan.variant

    def initialize(self, program: Any, config: ExecutionConfig | None = None) -> bool:
        config = config or self.plan.config
        if config.variant != self.plan.variant:
            return False
        self.program, self.config, self.initialized, self.converged = program, config, True, False
        if hasattr(program, "variant"):
            program.variant = config.variant
        return True

    def set_context(self, context: Context) -> None:
        self.context, self.state = context, None

    def application(self) -> Any:
        if self.program is None:
            raise RuntimeError("no program is bound")
        return self.program

    def context_is_valid(self) -> bool:
        return self.context is not None and self.context.satisfies(self.variant)

    def _begin(self) -> DataFrame:
        g, p = self.context.graph, self.program
        s = g.vertices.select("v", "deg", p.init_value(F.col("v")).alias("value"), p.init_buffer(F.col("v")).alias("buffer"))
        if self.variant.is_data_driven:
            front = self.context.frontier.distinct().withColumn("active", F.lit(True))
            return s.join(front, "v", "left").withColumn("active", F.coalesce("active", F.lit(False)))
        return s.withColumn("active", p.is_active(F.col("value"), F.col("buffer")))

    def _hop(self, state: DataFrame) -> DataFrame:
        g, p = self.context.graph, self.program
        src = state.select(F.col("v").alias("src"), F.col("value").alias("src_value"), F.col("buffer").alias("src_buffer"), F.col("deg").alias("src_deg"), F.col("active").alias("src_active"))
        edges = g.edges.select("src", "dst", F.coalesce(F.col("weight").cast("double"), F.lit(1.0)).alias("weight"))
        if self.variant.is_push:
            joined = src.where("src_active").join(edges, "src")
        else:
            joined = edges.join(src, "src").where("src_active")
        got = joined.groupBy(F.col("dst").alias("v")).agg(p.reduce(p.message(F.col("weight"))).alias("message"))
        s = state.join(got, "v", "left").withColumn("message", F.coalesce("message", p.identity()))
        value, buffer = p.post(F.col("value"), F.col("buffer"), F.col("active"))
        s = s.select("v", "deg", value.alias("value"), buffer.alias("buffer"), "message")
        value, buffer, on = p.combine(F.col("value"), F.col("buffer"), F.col("message"))
        out = s.select("v", "deg", value.alias("value"), buffer.alias("buffer"), on.alias("on"))
        # all vertices were asked for: what combine leaves untouched may still be active by its own buffer
        if self.variant.is_topology_driven:
            return out.withColumn("active", F.col("on") | (p.is_active(F.col("value"), F.col("buffer")) & F.lit(bool(getattr(self.program, "keeps_work", False))))).drop("on")
        return out.withColumnRenamed("on", "active")

    def _hops(self, most: int | None) -> int:
        own = 1 if self.variant.is_synchronous else self.hops
        return own if most is None else min(own, most)

    def execute_step(self, hops: int | None = None) -> StepResult:
        """One step; hops: of an asynchronous one so many at most."""
        if not self.initialized:
            return StepResult(Status.NOT_INITIALIZED)
        if not self.context_is_valid() or (getattr(self.program, "needs_weights", False) and not self.context.graph.has_weights and not getattr(self.program, "unit_weights", False)):
            return StepResult(Status.INVALID_CONTEXT)
        if self.converged:
            return StepResult(Status.CONVERGED)
        state = self.state if self.state is not None else self._begin()
        front = state.where("active").count()
        if not front:
            begun = self.state is not None
            self.state, self.converged = state, True
            return StepResult(Status.CONVERGED if begun else Status.NO_WORK)
        for _ in range(self._hops(hops)):
            state = self._hop(state)
        self.state = stored(state, self.state)
        left = self.state.where("active").count()
        self.converged = not left
        return StepResult(Status.CONVERGED if not left else Status.SUCCESS, front, left)

    def mark_converged(self) -> None:
        self.converged = True

    def clear_converged(self) -> None:
        self.converged = False

    def run(self, most: int = 1000, hops: int | None = None) -> DataFrame:
        """v, value after at most so many steps; hops: so many at most in all steps together, as hops over edges."""
        for _ in range(most):
            if hops == 0 or self.execute_step(hops).status is not Status.SUCCESS:
                break
            hops = None if hops is None else hops - self._hops(hops)
        if self.state is None:
            raise RuntimeError("the driver isn't ready")
        return self.state.select("v", "value")


def create_driver(what: Variant | ExecutionConfig | str | None = None) -> SuperstepDriver:
    return SuperstepDriver(select(what))

