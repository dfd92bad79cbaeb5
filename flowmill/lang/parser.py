"""Reads pipeline documents: a scanner by one pattern and a parser by precedence climbing."""

from __future__ import annotations

import re
from dataclasses import dataclass

from flowmill.lang.syntax import Array, Attributes, Binary, Block, Call, Check, Document, DocumentError, Expr, Join, Literal, Name, NullTest, Pipeline, PluginCall, When

_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)
      | (?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)
      | (?P<string>"(?:[^"\\]|\\.)*")
      | (?P<word>[A-Za-z_]\w*)
      | (?P<sign>==|!=|>=|<=|&&|\|\||[=<>+\-*/{}\[\](),.:])""",
    re.VERBOSE | re.DOTALL | re.ASCII,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
#: Binary operators by how tightly they bind, loosest first.
_LEVELS = ({"||": "or", "or": "or"}, {"&&": "and", "and": "and"}, {"==": "==", "!=": "!="}, {op: op for op in (">=", "<=", ">", "<")}, {"+": "+", "-": "-"}, {"*": "*", "/": "/"})


@dataclass
class Token:
    kind: str
    text: str
    line: int


def scan(text: str) -> list[Token]:
    tokens, at, line = [], 0, 1
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise DocumentError(f"unexpected {text[at]!r}", line)
        if m.lastgroup != "skip":
            tokens.append(Token(m.lastgroup or "", m[0], line))
        line += m[0].count("\n")
        at = m.end()
    return [*tokens, Token("end", "", line)]


class Parser:
    def __init__(self, text: str):
        self.tokens, self.at = scan(text), 0

    # -- tokens

    def peek(self, ahead: int = 0) -> Token:
        return self.tokens[min(self.at + ahead, len(self.tokens) - 1)]

    def take(self, *texts: str) -> Token:
        token = self.peek()
        if texts and (token.text not in texts or token.kind == "string"):
            raise DocumentError(f"expected {' or '.join(texts)}, found {token.text or 'the end'}", token.line)
        self.at += 1
        return token

    def accept(self, *texts: str) -> bool:
        if self.peek().text in texts and self.peek().kind != "string":
            self.at += 1
            return True
        return False

    def word(self) -> str:
        token = self.take()
        if token.kind != "word":
            raise DocumentError(f"expected a name, found {token.text or 'the end'}", token.line)
        return token.text

    def string(self) -> str:
        token = self.take()
        if token.kind != "string":
            raise DocumentError(f"expected a string, found {token.text or 'the end'}", token.line)
        return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), token.text[1:-1], flags=re.DOTALL)

    def until_brace(self):
        """Yields until the block's closing brace, which it takes."""
        self.take("{")
        while not self.accept("}"):
            if self.peek().kind == "end":
                raise DocumentError("a block isn't closed", self.peek().line)
            yield self.peek()

    # -- blocks

    def document(self) -> Document:
        doc = Document()
        while self.peek().kind != "end":
            token = self.take("define", "execution", "connection", "plugin", "pipeline")
            if token.text in ("define", "execution"):
                if getattr(doc, token.text):
                    doc.repeated.append(token.text)
                getattr(doc, token.text).update(self.attributes())
            elif token.text == "pipeline":
                p = self.pipeline(token.line)
                if any(p.name == q.name for q in doc.pipelines):
                    doc.repeated.append(f"pipeline {p.name}")
                doc.pipelines.append(p)
            else:
                name, held = self.string(), doc.connections if token.text == "connection" else doc.plugins
                if name in held:
                    doc.repeated.append(f"{token.text} {name}")
                held[name] = self.block()
        return doc

    def attributes(self) -> Attributes:
        out: Attributes = {}
        for _ in self.until_brace():
            name = self.word()
            self.take("=")
            out[name] = self.expression()
        return out

    def block(self) -> Block:
        out = Block()
        for _ in self.until_brace():
            name = self.word()
            if self.accept("="):
                out.attributes[name] = self.expression()
            else:
                out.blocks[name] = self.block()
        return out

    def fields(self) -> list[tuple[str, Expr]]:
        out = []
        for _ in self.until_brace():
            name = self.word()
            self.take("=")
            out.append((name, self.expression()))
        return out

    def pipeline(self, line: int) -> Pipeline:
        p = Pipeline(self.string(), line=line)
        for _ in self.until_brace():
            token = self.peek()
            name = self.word()
            if self.accept("="):
                p.attributes[name] = self.expression()
                continue
            match name:
                case "from":
                    self.endpoint(p, p.source, "from")
                case "to":
                    self.endpoint(p, p.target, "to")
                case "where":
                    label = self.string() if self.peek().kind == "string" else None
                    p.where.append((label, [self.expression() for _ in self.until_brace()]))
                case "with":
                    for _ in self.until_brace():
                        alias = self.word()
                        self.take("from")
                        p.joins.append(Join(alias, self.word(), self.expression() if self.accept("where") else None))
                case "select" if self.peek().kind == "string":
                    label = self.string()
                    p.named_selects[label] = self.fields()
                case "select":
                    p.select = (p.select or []) + self.fields()
                case "validate":
                    p.checks += [self.check() for _ in self.until_brace()]
                case "on_error":
                    p.on_error = self.block()
                case "paginate":
                    p.paginate = self.attributes()
                case "settings":
                    p.settings.update(self.attributes())
                case "before" | "after":
                    for _ in self.until_brace():
                        self.take("sql")
                        self.take("=")
                        for item in self.array().items:
                            if not isinstance(item, Literal) or not isinstance(item.value, str):
                                raise DocumentError("hooks are strings", token.line)
                            getattr(p, name).append(item.value)
                case _:
                    raise DocumentError(f"a pipeline has no block {name}", token.line)
        return p

    def endpoint(self, p: Pipeline, into: Block, side: str) -> None:
        for _ in self.until_brace():
            name = self.word()
            if self.accept("="):
                into.attributes[name] = self.expression()
            elif name == "with" and side == "from":
                self.take("references")
                p.references = self.attributes()
            elif name == "map" and side == "to":
                for source, target in self.fields():
                    p.table_map[source] = str(getattr(target, "value", target))
            else:
                into.blocks[name] = self.block()

    def check(self) -> Check:
        line = self.peek().line
        kind, name = self.take("assert", "warn").text, self.string()
        found: dict = {}
        for _ in self.until_brace():
            key = self.take("check", "message", "action").text
            self.take("=")
            found[key] = self.expression() if key == "check" else self.string() if key == "message" else self.word()
        if "check" not in found:
            raise DocumentError(f"{kind} {name} has no check", line)
        return Check(kind, name, **found)

    # -- expressions

    def expression(self, level: int = 0) -> Expr:
        if level == len(_LEVELS):
            return self.null_test()
        left = self.expression(level + 1)
        while self.peek().kind != "string" and (op := _LEVELS[level].get(self.peek().text)):
            self.at += 1
            left = Binary(op, left, self.expression(level + 1))
        return left

    def null_test(self) -> Expr:
        operand = self.primary()
        if self.peek().text == "is" and self.peek(1).text in ("not", "null"):
            self.at += 1
            negated = self.accept("not")
            self.take("null")
            return NullTest(operand, negated)
        return operand

    def primary(self) -> Expr:
        token = self.peek()
        if token.kind == "string":
            return Literal(self.string())
        if token.kind == "number" or token.text == "-" and self.peek(1).kind == "number":
            minus = self.accept("-")
            text = ("-" if minus else "") + self.take().text
            return Literal(float(text) if re.search("[.eE]", text) else int(text))
        if token.text == "[":
            return self.array()
        if self.accept("("):
            inside = self.expression()
            self.take(")")
            return inside
        if token.kind != "word":
            raise DocumentError(f"expected an expression, found {token.text or 'the end'}", token.line)
        if token.text in ("true", "false", "null"):
            self.at += 1
            return Literal({"true": True, "false": False, "null": None}[token.text])
        if token.text == "when" and self.peek(1).text == "{":
            return self.when()
        if token.text == "plugin" and self.peek(1).text == "." and self.peek(3).text == "(":
            return self.plugin_call()
        path = [self.word()]
        if self.accept("("):
            args = []
            while not self.accept(")"):
                args.append(self.expression())
                if self.peek().text != ")":
                    self.take(",")
            return Call(path[0].lower(), tuple(args))
        while self.peek().text == "." and self.peek(1).kind == "word":
            self.at += 1
            path.append(self.word())
        return Name(tuple(path))

    def array(self) -> Array:
        self.take("[")
        items = []
        while not self.accept("]"):
            items.append(self.expression())
            if self.peek().text != "]":
                self.take(",")
        return Array(tuple(items))

    def when(self) -> When:
        self.take("when")
        branches, otherwise = [], None
        for token in self.until_brace():
            if otherwise is not None:
                raise DocumentError("else comes last", token.line)
            if self.accept("else"):
                otherwise = self.expression()
            else:
                condition = self.expression()
                self.take("then")
                branches.append((condition, self.expression()))
        return When(tuple(branches), otherwise)

    def plugin_call(self) -> PluginCall:
        self.take("plugin")
        self.take(".")
        plugin = self.word()
        self.take("(")
        inputs = []
        for _ in self.until_brace():
            name = self.word()
            self.take(":")
            path = [self.word()]
            while self.accept("."):
                path.append(self.word())
            inputs.append((name, Name(tuple(path))))
            if self.peek().text != "}":
                self.take(",")
        self.take(")")
        return PluginCall(plugin, tuple(inputs))


def parse(text: str) -> Document:
    return Parser(text).document()
