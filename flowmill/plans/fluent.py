"""Pipelines written in Python instead of a document: the same trees, so the same plans."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame

from flowmill.lang.parser import Parser
from flowmill.lang.syntax import Binary, Check, DocumentError, Expr, Join, Name
from flowmill.operators.flow import Flow, Outcome


def expression(text: str | Expr) -> Expr:
    if not isinstance(text, str):
        return text
    parser = Parser(text)
    out = parser.expression()
    if parser.peek().kind != "end":
        raise DocumentError(f"unexpected {parser.peek().text}", parser.peek().line)
    return out


class PipelineBuilder:
    """`PipelineBuilder("orders").where("orders.x > 1").select(a="orders.x").build(frames)`; each call gives a new one."""

    def __init__(self, table: str, flow: Flow | None = None):
        self.flow = flow or Flow(table)

    def _with(self, **changes) -> PipelineBuilder:
        return PipelineBuilder(self.flow.table, replace(self.flow, **changes))

    def where(self, *conditions: str | Expr) -> PipelineBuilder:
        return self._with(where=[*self.flow.where, *map(expression, conditions)])

    def join(self, alias: str, on: tuple[str, str], table: str | None = None, how: str = "inner") -> PipelineBuilder:
        """`on` has the two columns, as table.column; `how` is inner, left, right or full."""
        if how not in ("inner", "left", "right", "full"):
            raise DocumentError(f"there is no join {how}")
        left, right = (Name(tuple(x.split("."))) for x in on)
        return self._with(joins=[*self.flow.joins, Join(alias, table or alias, Binary("==", left, right), how)])

    def select(self, **fields: str | Expr) -> PipelineBuilder:
        return self._with(select=[*(self.flow.select or []), *[(n, expression(e)) for n, e in fields.items()]])

    def check(self, name: str, condition: str | Expr, action: str = "warn", message: str | None = None) -> PipelineBuilder:
        return self._with(checks=[*self.flow.checks, Check("assert", name, expression(condition), message, action)])

    def build(self, frames: dict[str, DataFrame]) -> Outcome:
        return self.flow.build(frames[self.flow.table], frames.__getitem__)
