"""What is wrong with a document before anything is read: missing parts, unknown names, cycles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from graphlib import CycleError, TopologicalSorter

from flowmill.lang.syntax import Array, Binary, Call, Document, Expr, Literal, Name, NullTest, Pipeline, PluginCall, When


@dataclass(frozen=True)
class Issue:
    severity: str
    code: str
    message: str


def parts(e: Expr | None) -> Iterator[Expr]:
    """The expression and all inside it."""
    if e is None:
        return
    yield e
    inside: tuple = ()
    match e:
        case Binary():
            inside = (e.left, e.right)
        case NullTest():
            inside = (e.operand,)
        case When():
            inside = (*[x for b in e.branches for x in b], e.otherwise)
        case Call():
            inside = e.args
        case Array():
            inside = e.items
        case PluginCall():
            inside = tuple(n for _, n in e.inputs)
    for x in inside:
        yield from parts(x)


def expressions(p: Pipeline) -> Iterator[Expr]:
    for held in (p.attributes, p.source.attributes, p.target.attributes, p.settings, p.paginate or {}, p.references or {}):
        yield from held.values()
    for _, conditions in p.where:
        yield from conditions
    for j in p.joins:
        if j.condition is not None:
            yield j.condition
    for fields in [p.select or [], *p.named_selects.values()]:
        yield from (e for _, e in fields)
    yield from (c.check for c in p.checks)


def reference(e: Expr | None, kind: str) -> str | None:
    """The name in `kind.name`."""
    return e.path[1] if isinstance(e, Name) and len(e.path) == 2 and e.path[0] == kind else None


def depends_on(p: Pipeline) -> list[str]:
    """Pipelines named in `after`, as strings or as pipeline.name."""
    e = p.attributes.get("after")
    items = e.items if isinstance(e, Array) else () if e is None else (e,)
    return [str(x.value) if isinstance(x, Literal) else reference(x, "pipeline") or str(x) for x in items]


def cycle(graph: dict[str, list[str]]) -> list[str] | None:
    try:
        TopologicalSorter(graph).prepare()
    except CycleError as e:
        return list(e.args[1])
    return None


def check(doc: Document) -> list[Issue]:
    """Errors and warnings, in the order of the document."""
    out = [Issue("error", "DUPLICATE", f"{name} is declared twice") for name in doc.repeated]
    error = lambda code, message: out.append(Issue("error", code, message))
    for name, c in doc.connections.items():
        if "driver" not in c.attributes:
            error("MISSING_DRIVER", f"connection {name} has no driver")
        driver = getattr(c.attributes.get("driver"), "value", None)
        if driver == "wasm":
            if "plugin" not in c.attributes:
                error("MISSING_PLUGIN", f"connection {name} names no plugin")
        elif "url" not in c.attributes and "driver" in c.attributes:
            error("MISSING_URL", f"connection {name} has no url")
    used: dict[str, set[str]] = {"connection": set(), "define": set(), "plugin": set()}
    names = {p.name for p in doc.pipelines}
    for c in doc.connections.values():
        for e in c.attributes.values():
            used["define"] |= {n for x in parts(e) if (n := reference(x, "define"))}
        if isinstance(plugin := c.attributes.get("plugin"), Literal):
            used["plugin"].add(str(plugin.value))
    for p in doc.pipelines:
        for side, block in (("from", p.source), ("to", p.target)):
            if not block.attributes:
                error(f"MISSING_{side.upper()}", f"pipeline {p.name} has no {side}")
            elif (name := reference(block.attributes.get("connection"), "connection")) is None:
                error("MISSING_CONNECTION", f"pipeline {p.name} names no connection in {side}")
        nested = [b.attributes for b in p.on_error.blocks.get("failed_rows", p.on_error).blocks.values()]
        for e in [*expressions(p), *[e for a in nested for e in a.values()]]:
            for x in parts(e):
                for kind in ("connection", "define"):
                    if name := reference(x, kind):
                        used[kind].add(name)
                if isinstance(x, PluginCall):
                    used["plugin"].add(x.plugin)
        for dep in depends_on(p):
            if dep not in names:
                error("UNDEFINED_PIPELINE", f"pipeline {p.name} comes after {dep}, which isn't declared")
    for e in doc.define.values():
        used["define"] |= {n for x in parts(e) if (n := reference(x, "define"))}
    for kind, declared in (("connection", doc.connections), ("define", doc.define), ("plugin", doc.plugins)):
        for name in sorted(used[kind] - set(declared)):
            error(f"UNDEFINED_{kind.upper()}", f"{kind} {name} isn't declared")
        for name in declared:
            if name not in used[kind]:
                out.append(Issue("warning", f"UNUSED_{kind.upper()}", f"{kind} {name} isn't used"))
    if found := cycle({n: [x for e in parts(v) if (x := reference(e, "define"))] for n, v in doc.define.items()}):
        error("DEFINE_CYCLE", "define goes in a circle: " + " -> ".join(found))
    if found := cycle({p.name: depends_on(p) for p in doc.pipelines}):
        error("PIPELINE_CYCLE", "pipelines wait for each other: " + " -> ".join(found))
    return out
