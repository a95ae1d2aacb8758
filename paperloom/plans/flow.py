"""A small workflow: named steps, ordered conditional edges, several entries.

Steps transform whole DataFrames of sessions.  Routing is a column: each session
carries the step it is at, the path it has taken and its errors, so sessions that
take different ways run through the same plan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

END, FAILED = "__end__", "__failed__"
MAX_STEPS = 50
Step = Callable[[DataFrame], DataFrame]
Progress = Callable[[str, str], None]


class FlowError(ValueError):
    """The workflow is not well formed."""


@dataclass(frozen=True)
class Edge:
    source: str
    target: str
    condition: Column | None = None
    label: str = ""


@dataclass
class Flow:
    """Sessions need the columns ``at`` (string), ``path`` and ``errors`` (array<string>); ``start`` adds them."""

    steps: dict[str, tuple[Step, str]] = field(default_factory=dict)
    edges: list[Edge] = field(default_factory=list)
    entries: dict[str, str] = field(default_factory=dict)

    def step(self, name: str, run: Step, about: str = "") -> Flow:
        if name in self.steps or name in (END, FAILED):
            raise FlowError(f"the step name {name} is taken")
        self.steps[name] = (run, about)
        return self

    def edge(self, source: str, target: str, condition: Column | None = None, label: str = "") -> Flow:
        self.edges.append(Edge(source, target, condition, label))
        return self

    def entry(self, name: str, step: str) -> Flow:
        self.entries[name] = step
        return self

    def validate(self) -> Flow:
        for problem in self.problems():
            raise FlowError(problem)
        return self

    def problems(self) -> list[str]:
        known = {*self.steps, END, FAILED}
        found = [f"edge {e.source} -> {e.target} names an unknown step" for e in self.edges if e.source not in self.steps or e.target not in known]
        found += [f"entry {n} names the unknown step {s}" for n, s in self.entries.items() if s not in self.steps]
        for name in self.steps:
            out = [e for e in self.edges if e.source == name]
            if not out:
                found.append(f"step {name} has no way out")
            elif all(e.condition is not None for e in out):
                found.append(f"step {name} has conditional ways out only")
        return found

    def next_step(self, source: str) -> Column:
        """The target of the first edge whose condition holds, as a column."""
        choice: Column | None = None
        for e in (e for e in self.edges if e.source == source):
            holds = F.lit(True) if e.condition is None else F.coalesce(e.condition, F.lit(False))
            choice = F.when(holds, e.target) if choice is None else choice.when(holds, e.target)
        if choice is None:
            raise FlowError(f"step {source} has no way out")
        return choice

    def start(self, sessions: DataFrame, entry: str) -> DataFrame:
        empty = F.array().cast("array<string>")
        return sessions.withColumns({"at": F.lit(self.entries[entry]), "path": empty, "errors": empty})

    def order(self, entry: str) -> list[str]:
        """Steps in an order in which all ways of an entry can be run through once; a cycle is an error."""
        done: list[str] = []
        open_: list[str] = []

        def visit(name: str) -> None:
            if name in open_:
                raise FlowError(f"steps form a cycle through {name}")
            if name in done or name not in self.steps:
                return
            open_.append(name)
            for e in self.edges:
                if e.source == name:
                    visit(e.target)
            open_.remove(name)
            done.append(name)

        visit(self.entries[entry])
        if len(done) > MAX_STEPS:
            raise FlowError(f"more than {MAX_STEPS} steps")
        return done[::-1]

    def run(self, sessions: DataFrame, entry: str, progress: Progress | None = None) -> DataFrame:
        """Runs every session from an entry to its end; a session with a new error stops there.

        A step may only add or change columns, and append to ``errors``.
        """
        rows = self.start(sessions, entry)
        for name in self.order(entry):
            if progress:
                progress(name, self.steps[name][1])
            here = rows.where(F.col("at") == name).withColumns({"path": F.array_append("path", F.lit(name)), "__before": F.size("errors")})
            after = self.steps[name][0](here)
            after = after.withColumn("at", F.when(F.size("errors") > F.col("__before"), FAILED).otherwise(self.next_step(name))).drop("__before")
            rows = rows.where(F.col("at") != name).unionByName(after, allowMissingColumns=True)
        return rows

    def reachable(self, step: str) -> set[str]:
        seen: set[str] = set()
        todo = [step]
        while todo:
            name = todo.pop()
            if name in self.steps and name not in seen:
                seen.add(name)
                todo += [e.target for e in self.edges if e.source == name]
        return seen

    def mermaid(self) -> str:
        """The workflow as a Mermaid flowchart; steps of one entry are grouped, shared ones stand outside."""
        reach = {n: self.reachable(s) for n, s in self.entries.items()}
        shared = [s for s in self.steps if sum(s in r for r in reach.values()) > 1]
        box = lambda s: f'{s}["{s}<br/>{self.steps[s][1]}"]' if self.steps[s][1] else s
        out = ["flowchart TD", *(f"    {n}_entry([{n}]) --> {s}" for n, s in self.entries.items())]
        for n, r in reach.items():
            out += [f"    subgraph {n}_steps [{n}]", *(f"        {box(s)}" for s in self.steps if s in r and s not in shared), "    end"]
        out += [f"    {box(s)}" for s in shared]
        for e in self.edges:
            target = {END: "finish([end])", FAILED: "stop([failed])"}.get(e.target, e.target)
            out.append(f"    {e.source} --{f' {e.label} --' if e.label else ''}> {target}")
        return "\n".join(out)

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(nodes, edges, entries) as DataFrames."""
        nodes = spark.createDataFrame([(n, a) for n, (_, a) in self.steps.items()] or [], "node string, about string")
        edges = spark.createDataFrame([(i, e.source, e.target, e.condition is not None, e.label) for i, e in enumerate(self.edges)] or [], "ord int, source string, target string, conditional boolean, label string")
        return nodes, edges, spark.createDataFrame(list(self.entries.items()) or [], "entry string, node string")


def find_problems(nodes: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """(subject, problem) of workflow tables, by anti-joins."""
    names = nodes.select(F.col("node").alias("__n"))
    ends = names.unionByName(names.sparkSession.createDataFrame([(END,), (FAILED,)], "__n string"))
    label = F.concat_ws(" -> ", "source", "target")
    sources = edges.join(names, F.col("source") == F.col("__n"), "left_anti").select(label.alias("subject"), F.lit("unknown source").alias("problem"))
    targets = edges.join(ends, F.col("target") == F.col("__n"), "left_anti").select(label, F.lit("unknown target"))
    starts = entries.join(names, F.col("node") == F.col("__n"), "left_anti").select("entry", F.lit("unknown entry step"))
    closed = nodes.join(edges, F.col("node") == F.col("source"), "left_anti").select("node", F.lit("no way out"))
    only = edges.groupBy("source").agg(F.bool_and("conditional").alias("all")).join(names, F.col("source") == F.col("__n"), "left_semi").where("all").select("source", F.lit("conditional ways out only"))
    return sources.union(targets).union(starts).union(closed).union(only)


def reachability(edges: DataFrame, starts: DataFrame, depth: int = MAX_STEPS) -> DataFrame:
    """(entry, node) pairs: steps that each entry reaches, itself included."""
    spark = edges.sparkSession
    # UNION ALL with a depth bound: cycles end, and what they repeat is removed after
    return spark.sql(
        """
        WITH RECURSIVE reach(entry, node, depth) AS (
          SELECT entry, node, 0 FROM {starts}
          UNION ALL
          SELECT r.entry, e.target, r.depth + 1 FROM reach r JOIN {edges} e ON e.source = r.node WHERE r.depth < {depth}
        )
        SELECT DISTINCT entry, node FROM reach
        """,
        starts=starts,
        edges=edges,
        depth=depth,
    )
