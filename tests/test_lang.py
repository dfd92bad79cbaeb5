import pytest
from flowmill.lang.checks import check, depends_on
from flowmill.lang.parser import parse
from flowmill.lang.syntax import Array, Binary, Call, DocumentError, Literal, Name, NullTest, When
from hypothesis import given, settings
from hypothesis import strategies as st


def expr(text):
    return parse("define { x = %s }" % text).define["x"]


def test_precedence_and_chains():
    a, b, c = (Name((n,)) for n in "abc")
    assert expr("a + b + c") == Binary("+", Binary("+", a, b), c)
    assert expr("a + b * c") == Binary("+", a, Binary("*", b, c))
    assert expr("a or b and c == a") == Binary("or", a, Binary("and", b, Binary("==", c, a)))
    assert expr("a || b && c") == expr("a or b and c")
    assert expr("(a + b) * c is not null") == Binary("*", Binary("+", a, b), NullTest(c, True))
    assert expr("a - 1") == Binary("-", a, Literal(1)) and expr("-1.5e3") == Literal(-1500.0)


def test_values():
    assert expr('"a\\"b\\n"') == Literal('a"b\n') and expr("null") == Literal(None) and expr("true") == Literal(True)
    assert expr("[1, 2,]") == Array((Literal(1), Literal(2))) and expr("Lower(t.c)") == Call("lower", (Name(("t", "c")),))
    assert expr('when { a > 1 then "x" else null }') == When(((Binary(">", Name(("a",)), Literal(1)), Literal("x")),), Literal(None))
    assert isinstance(expr("2"), Literal) and type(expr("2").value) is int and type(expr("2.0").value) is float


DOCUMENT = """
// a comment
define { limit = 10 /* and another */ }
execution { strategy = "parallel" max_concurrency = 4 }
connection "a" { driver = "parquet" url = "x" pool { size = 3 } }
plugin "p" { path = "p.py" config { k = 1 } }
pipeline "one" {
  from { connection = connection.a table = "t" with references { data = "cascade" depth = 2 } }
  to { connection = connection.a table = "u" mode = "replace" map { t = "u" } }
  with { j from other where j.id == t.id }
  where "named" { t.x > define.limit t.y is not null }
  where { t.z == "q" }
  select { a = t.x b = plugin.p({ v: t.y, w: z }) }
  select "other" { c = other.d }
  validate { assert "r" { check = a > 1 message = "m" action = skip } warn "w" { check = b is null } }
  on_error { retry { max_attempts = 2 delay_ms = 5 } failed_rows { file { path = "f" format = "json" } } }
  paginate { strategy = "pk" cursor = "id" }
  before { sql = ["SET x=1"] }
  after { sql = ["SET y=2", "SET z=3"] }
  settings { batch_size = 5 lanes = 3 }
}
pipeline "two" { after = ["one"] from { connection = connection.a table = "u" } to { connection = connection.a table = "v" } }
"""


def test_document():
    doc = parse(DOCUMENT)
    assert [i for i in check(doc) if i.severity == "error"] == [] == check(doc)
    one, two = doc.pipelines
    assert len(one.where) == 2 and len(one.where[0][1]) == 2 and one.joins[0].alias == "j" and one.table_map == {"t": "u"}
    assert one.named_selects["other"] == [("c", Name(("other", "d")))] and one.checks[0].action == "skip" and one.checks[1].kind == "warn"
    assert one.after == ["SET y=2", "SET z=3"] and depends_on(two) == ["one"] and one.references["depth"] == Literal(2)
    assert one.on_error.blocks["failed_rows"].blocks["file"].attributes["path"] == Literal("f")


@pytest.mark.parametrize(
    ("text", "code"),
    [
        ('connection "a" { url = "x" }', "MISSING_DRIVER"),
        ('connection "a" { driver = "csv" }', "MISSING_URL"),
        ('connection "a" { driver = "wasm" }', "MISSING_PLUGIN"),
        ('connection "a" { driver = "csv" url = "x" } connection "a" { driver = "csv" url = "x" }', "DUPLICATE"),
        ('pipeline "p" { }', "MISSING_FROM"),
        ('pipeline "p" { from { connection = connection.no } }', "MISSING_TO"),
        ('pipeline "p" { from { connection = connection.no } }', "UNDEFINED_CONNECTION"),
        ('pipeline "p" { from { table = "t" } }', "MISSING_CONNECTION"),
        ('pipeline "p" { where { t.x == define.no } }', "UNDEFINED_DEFINE"),
        ('pipeline "p" { select { a = plugin.no({ x: y }) } }', "UNDEFINED_PLUGIN"),
        ('pipeline "p" { after = ["no"] }', "UNDEFINED_PIPELINE"),
        ('pipeline "p" { after = ["q"] } pipeline "q" { after = ["p"] }', "PIPELINE_CYCLE"),
        ("define { a = define.b b = define.a }", "DEFINE_CYCLE"),
        ("define { a = 1 }", "UNUSED_DEFINE"),
        ('pipeline "p" { } pipeline "p" { }', "DUPLICATE"),
    ],
)
def test_issues(text, code):
    assert code in {i.code for i in check(parse(text))}


@pytest.mark.parametrize("text", ["define {", "define { a }", 'pipeline p { }', "define { a = }", "define { a = 1 + }", 'pipeline "p" { nothing { } }', 'pipeline "p" { validate { assert "x" { message = "y" } } }', "define { a = ~ }", 'define { a = "x }', "define { a = when { else 1 b then 2 } }"])
def test_errors_have_a_line(text):
    with pytest.raises(DocumentError, match="line 1"):
        parse(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='abc{}[]()=<>!&|+-*/."\n ,:0123456789', max_size=40))
def test_any_text_is_read_or_refused(text):
    try:
        parse(text)
    except DocumentError:
        pass
