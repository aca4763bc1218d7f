"""Chat formatting by a small template compiler (operator 1).

A template is parsed to a syntax tree, constants in it are folded, and each node becomes a Python closure. Rendering
runs the closures and gives pieces of text, each marked as generated (inside a generation block, so under the loss mask)
or not. The language is a sandbox: values are text, numbers, booleans, lists and mappings; there are no calls, no
attributes of Python objects and no loops but over given lists.

    {{ expr }}   {# note #}   {% set x = expr %}   {% generation %} ... {% endgeneration %}
    {% if expr %} ... {% elif expr %} ... {% else %} ... {% endif %}
    {% for x in expr %} ... {% endfor %}    with loop.index, loop.first, loop.last

Expressions: literals, names, x.key, x['key'], x | filter, not, and, or, ==, !=, <, <=, >, >=, in, +, -, ~.

Defined results: a null text or role is empty; rows of a conversation are ordered by turn, role and text (nulls first),
repeated rows are turns of their own; a null conv_id is a conversation; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
TEMPLATE = (
    "{% for m in messages %}<s>{% if m.role == 'user' %}[INST] {{ m.text | escape }} [/INST]"
    "{% elif m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}[ROLE] {{ m.role | escape }} [/ROLE]{{ m.text | escape }}{% endif %}</s>{% endfor %}"
)

_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))


def escape(text: str) -> str:
    """Text without any control string: a backslash is doubled, and one is put after a control string's first character."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


FILTERS: dict[str, Callable] = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower, "length": len, "string": str}


class TemplateError(ValueError):
    pass


# ---------------------------------------------------------------- syntax tree


@dataclass
class Const:
    value: object


@dataclass
class Name:
    name: str


@dataclass
class Item:
    of: object
    key: object


@dataclass
class Op:
    op: str
    args: list


@dataclass
class Text:
    text: str


@dataclass
class Out:
    expr: object


@dataclass
class Let:
    name: str
    expr: object


@dataclass
class If:
    cases: list  # of (condition, body); the last condition may be Const(True)


@dataclass
class For:
    name: str
    expr: object
    body: list


@dataclass
class Generation:
    body: list


_TAG = re.compile(r"\{\{-?(.*?)-?\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"\s*(?:(\d+)|'((?:[^'\\]|\\.)*)'|\"((?:[^\"\\]|\\.)*)\"|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+~<>()\[\].|=]))", re.S)
_ESCAPES = {"n": "\n", "t": "\t"}


@dataclass
class _Expression:
    """Recursive descent over the tokens of one tag."""

    source: str
    tokens: list = field(default_factory=list)
    at: int = 0

    def __post_init__(self):
        at, text = 0, self.source.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise TemplateError(f"can't read {text[at:]!r}")
            number, single, double, name, sign = m.groups()
            if number is not None:
                self.tokens.append(("const", int(number)))
            elif single is not None or double is not None:
                self.tokens.append(("const", re.sub(r"\\(.)", lambda x: _ESCAPES.get(x[1], x[1]), single if single is not None else double, flags=re.S)))
            else:
                self.tokens.append(("name", name) if name else ("sign", sign))
            at = m.end()

    def take(self, *values: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] != "const" and self.tokens[self.at][1] in values:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError(f"a name is missing in {self.source!r}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} is missing in {self.source!r}")

    def whole(self):
        x = self.any_of(0)
        if self.at != len(self.tokens):
            raise TemplateError(f"more than one expression in {self.source!r}")
        return x

    LEVELS = (("or",), ("and",), ("not",), ("==", "!=", "<", "<=", ">", ">=", "in"), ("+", "-", "~"))

    def any_of(self, level: int):
        if level == len(self.LEVELS):
            return self.postfix()
        if self.LEVELS[level] == ("not",):
            return Op("not", [self.any_of(level)]) if self.take("not") else self.any_of(level + 1)
        x = self.any_of(level + 1)
        while op := self.take(*self.LEVELS[level]):
            x = Op(op, [x, self.any_of(level + 1)])
        return x

    def postfix(self):
        x = self.primary()
        while sign := self.take(".", "[", "|"):
            if sign == ".":
                x = Item(x, Const(self.name()))
            elif sign == "[":
                x = Item(x, self.any_of(0))
                self.need("]")
            elif (f := self.name()) in FILTERS:
                x = Op("|" + f, [x])
            else:
                raise TemplateError(f"no filter {f!r}")
        return x

    def primary(self):
        if self.take("("):
            x = self.any_of(0)
            self.need(")")
            return x
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "const":
            self.at += 1
            return Const(self.tokens[self.at - 1][1])
        name = self.name()
        return Const({"true": True, "false": False, "none": None}[name]) if name in ("true", "false", "none") else Name(name)


def parse(template: str) -> list:
    """The syntax tree: a list of nodes."""
    parts, at = [], 0
    for m in _TAG.finditer(template):
        parts.append(("text", template[at : m.start()]))
        if m[1] is not None:
            parts.append(("out", m[1]))
        elif m[2] is not None:
            parts.append(("tag", m[2].strip()))
        at = m.end()
    parts.append(("text", template[at:]))
    at = 0

    def block(*ends: str) -> tuple[list, str]:
        nonlocal at
        nodes: list = []
        while at < len(parts):
            kind, value = parts[at]
            at += 1
            word, _, rest = value.partition(" ")
            if kind == "text":
                nodes.append(Text(value))
            elif kind == "out":
                nodes.append(Out(_Expression(value).whole()))
            elif word in ends:
                return nodes, value
            elif word == "set":
                e = _Expression(rest)
                name = e.name()
                e.need("=")
                nodes.append(Let(name, e.whole()))
            elif word == "generation":
                nodes.append(Generation(block("endgeneration")[0]))
            elif word == "for":
                e = _Expression(rest)
                name = e.name()
                e.need("in")
                nodes.append(For(name, e.whole(), block("endfor")[0]))
            elif word == "if":
                cases, test = [], _Expression(rest).whole()
                while True:
                    body, end = block("elif", "else", "endif")
                    cases.append((test, body))
                    if end == "endif":
                        break
                    test = Const(True) if end == "else" else _Expression(end.partition(" ")[2]).whole()
                nodes.append(If(cases))
            else:
                raise TemplateError(f"unexpected tag {value!r}")
        if ends:
            raise TemplateError(f"no {ends[-1]!r}")
        return nodes, ""

    return block()[0]


# ---------------------------------------------------------------- folding


def _text(x: object) -> str:
    return "" if x is None else str(x)


def _item(of: object, key: object) -> object:
    """The sandbox's only access: keys of mappings, places of lists and texts; null where there is none."""
    if isinstance(of, dict):
        return of.get(key)
    return of[key] if isinstance(of, (list, tuple, str)) and isinstance(key, int) and -len(of) <= key < len(of) else None


OPS: dict[str, Callable] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "~": lambda a, b: _text(a) + _text(b),
    "not": lambda a: not a,
}


def _apply(op: str, *args: object) -> object:
    return FILTERS[op[1:]](*args) if op[0] == "|" else OPS[op](*args)


def fold_expr(x):
    if isinstance(x, Item):
        of, key = fold_expr(x.of), fold_expr(x.key)
        return Const(_item(of.value, key.value)) if isinstance(of, Const) and isinstance(key, Const) else Item(of, key)
    if not isinstance(x, Op):
        return x
    args = [fold_expr(a) for a in x.args]
    if x.op in ("and", "or"):
        if isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (x.op == "and") else args[0]
    elif all(isinstance(a, Const) for a in args):
        return Const(_apply(x.op, *(a.value for a in args)))
    return Op(x.op, args)


def fold(nodes: list) -> list:
    """The same tree with constant expressions computed, dead branches left out and neighbouring texts joined."""
    out: list = []

    def add(node) -> None:
        if isinstance(node, Text):
            if node.text and out and isinstance(out[-1], Text):
                out[-1] = Text(out[-1].text + node.text)
            elif node.text:
                out.append(node)
        else:
            out.append(node)

    for node in nodes:
        if isinstance(node, Out):
            e = fold_expr(node.expr)
            add(Text(_text(e.value)) if isinstance(e, Const) else Out(e))
        elif isinstance(node, Let):
            add(Let(node.name, fold_expr(node.expr)))
        elif isinstance(node, For):
            add(For(node.name, fold_expr(node.expr), fold(node.body)))
        elif isinstance(node, Generation):
            add(Generation(fold(node.body)))
        elif isinstance(node, If):
            cases = []
            for test, body in node.cases:
                test = fold_expr(test)
                if isinstance(test, Const) and not test.value:
                    continue
                cases.append((test, fold(body)))
                if isinstance(test, Const):
                    break
            if cases and isinstance(cases[0][0], Const):
                for x in cases[0][1]:
                    add(x)
            elif cases:
                add(If(cases))
        else:
            add(node)
    return out


# ---------------------------------------------------------------- closures

Emit = Callable[[dict, bool], Iterator[tuple[str, bool]]]


def _value(x) -> Callable[[dict], object]:
    if isinstance(x, Const):
        return lambda scope: x.value
    if isinstance(x, Name):
        return lambda scope: scope.get(x.name)
    if isinstance(x, Item):
        of, key = _value(x.of), _value(x.key)
        return lambda scope: _item(of(scope), key(scope))
    args = [_value(a) for a in x.args]
    if x.op == "and":
        return lambda scope: args[0](scope) and args[1](scope)
    if x.op == "or":
        return lambda scope: args[0](scope) or args[1](scope)
    if len(args) == 1:
        f, a = (FILTERS[x.op[1:]] if x.op[0] == "|" else OPS[x.op]), args[0]
        return lambda scope: f(a(scope))
    f, a, b = OPS[x.op], *args
    return lambda scope: f(a(scope), b(scope))


def _emit(nodes: list) -> Emit:
    steps = [_step(n) for n in nodes]

    def run(scope: dict, generated: bool) -> Iterator[tuple[str, bool]]:
        for step in steps:
            yield from step(scope, generated)

    return run


def _step(node) -> Emit:
    if isinstance(node, Text):
        return lambda scope, generated: iter(((node.text, generated),))
    if isinstance(node, Out):
        value = _value(node.expr)
        return lambda scope, generated: iter(((_text(value(scope)), generated),))
    if isinstance(node, Let):
        value = _value(node.expr)

        def put(scope: dict, generated: bool) -> Iterator[tuple[str, bool]]:
            scope[node.name] = value(scope)
            return iter(())

        return put
    if isinstance(node, Generation):
        body = _emit(node.body)
        return lambda scope, generated: body(scope, True)
    if isinstance(node, If):
        cases = [(_value(test), _emit(body)) for test, body in node.cases]

        def choose(scope: dict, generated: bool) -> Iterator[tuple[str, bool]]:
            return next((body(scope, generated) for test, body in cases if test(scope)), iter(()))

        return choose
    items, body, end = _value(node.expr), _emit(node.body), object()

    def loop(scope: dict, generated: bool) -> Iterator[tuple[str, bool]]:
        rest = iter(items(scope) or ())
        now, inner = next(rest, end), dict(scope)
        for index in itertools.count(1):
            if now is end:
                return
            after = next(rest, end)
            inner[node.name], inner["loop"] = now, {"index": index, "first": index == 1, "last": after is end}
            yield from body(inner, generated)
            now = after

    return loop


def compile_template(template: str) -> Callable[[dict], Iterator[tuple[str, bool]]]:
    """A function from variables to pieces (text, generated)."""
    run = _emit(fold(parse(template)))
    return lambda variables: run(dict(variables), False)


def render(run: Callable, messages: Iterable[dict]) -> tuple[str, list[int], list[int]]:
    """The whole text, and starts and ends of its generated spans in code points."""
    out, starts, ends, at = [], [], [], 0
    for text, generated in run({"messages": messages}):
        if generated and text:
            if ends and ends[-1] == at:
                ends[-1] = at + len(text)
            else:
                starts.append(at)
                ends.append(at + len(text))
        at += len(text)
        out.append(text)
    return "".join(out), starts, ends


# ---------------------------------------------------------------- Spark

FORMATTED = "conv_id long, formatted string, starts array<long>, ends array<long>"


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """A row per conversation: conv_id, formatted, starts and ends of what is under the loss mask (code points).

    A conversation's rows meet in one task, as its text is one value; the task reads rows in order and holds no more than
    one conversation."""
    names = ["conv_id", "turn", "role", "text"]
    rows = conversations.select(*names).repartition("conv_id").sortWithinPartitions(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = compile_template(template)
        stream = (row for b in batches for row in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()))
        out, held = [], 0
        for conv_id, group in itertools.groupby(stream, key=lambda r: r[0]):
            made = render(compiled, ({"role": role or "", "text": text or ""} for _, role, text in group))
            out.append((conv_id, *made))
            held += len(made[0])
            if held > 4_000_000:
                yield _batch(out, FORMATTED_ARROW)
                out, held = [], 0
        if out:
            yield _batch(out, FORMATTED_ARROW)

    return rows.mapInArrow(run, FORMATTED)


FORMATTED_ARROW = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
DIGEST_ARROW = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn, from the output of TEMPLATE alone."""
    at = 0
    while at < len(formatted):
        end = formatted.index("</s>", at)
        body = formatted[at + len("<s>") : end]
        if body.startswith("[INST] "):
            yield "user", unescape(body[len("[INST] ") : -len(" [/INST]")])
        elif body.startswith("[ROLE] "):
            role, _, text = body[len("[ROLE] ") :].partition(" [/ROLE]")
            yield unescape(role), unescape(text)
        else:
            yield "assistant", unescape(body)
        at = end + len("</s>")


def digests(formatted: DataFrame) -> DataFrame:
    """Turns and loss text, read back from formatted conversations, as digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for conv_id, text, starts, ends in zip(*(c.to_pylist() for c in b.columns)):
                turns, loss, n, n_loss = hashlib.sha256(), hashlib.sha256(), 0, 0
                for role, said in read_turns(text):
                    turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                    n += 1
                for a, z in zip(starts, ends):
                    said = unescape(text[a:z])
                    loss.update(said.encode("utf-8", "surrogatepass"))
                    n_loss += len(said)
                out.append((conv_id, n, turns.hexdigest(), n_loss, loss.hexdigest(), len(text)))
            if out:
                yield _batch(out, DIGEST_ARROW)

    return formatted.mapInArrow(run, DIGEST)


def op1(spark, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, whose turns consist of control strings."""
    from plumbline.llm.common import table

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")
    )
    return digests(format_conversations(rows.unionByName(odd)))


_TURN = "coalesce(text, '')"
_ESCAPED = f"replace({_TURN}, '\\', '\\\\')"
for _c in CONTROLS:
    _ESCAPED = f"replace({_ESCAPED}, '{_c}', '{_c[0]}\\{_c[1:]}')"
_ROLE = _ESCAPED.replace("coalesce(text, '')", "coalesce(role, '')")
OP1_SQL = rf"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, {_TURN} AS text, length({_ESCAPED}) AS n, length({_ROLE}) AS n_role FROM (
  SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n + 7 + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 0 ELSE 15 + n_role END)::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""
