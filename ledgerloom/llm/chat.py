"""Operator 8: chat formatting by a template compiler.

The template language has {{ expression }}, {# comment #}, {% for x in xs %}, {% if %}, {% elif %}, {% else %},
{% set name = value %}, {% set name %}, {% raw %} and {% generation %} (the loss mask); loops may unpack and filter
their items, and blocks are closed by {% end... %}, and a minus
inside a mark takes the white space on its side. Expressions are literals, names, fields, indexes, slices,
mappings, comparisons, `is` tests, and/or/not, arithmetic, ~, the conditional, filters after |, and a few functions
and string methods by name; there is no access to anything but the template's variables. They are read
into a syntax tree, constant parts are folded, and the tree becomes Python closures that write the text
and note where generation begins and ends.

A template whose loop over the messages looks at one message at a time is rendered turn by turn, so that a
conversation may be longer than a task's memory; others have their conversation whole in one task.

Defined results: null text and role are empty; turns are ordered by turn, then role and text, so
repeated turns each count; rows without conv_id are one conversation; an empty table gives an empty
result; other columns are ignored. What isn't defined in a template prints nothing and is false;
a field of it, or a loop variable outside a loop, is an error. Every fault of a template, and a text or range
that is too long, is a TemplateError.
"""

from __future__ import annotations

import ast
import hashlib
import io
import json
import operator
import re
import tokenize
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]", "[TEXT]")
TEMPLATE = (
    "{{ '<s>' }}{% for m in messages %}"
    "{% if m.role == 'user' %}[INST] {{ m.text | escape }} [/INST]"
    "{% elif m.role == 'assistant' %} {% generation %}{{ m.text | escape }}{% endgeneration %}</s>"
    "{% elif m.role == 'system' %}[SYS] {{ m.text | escape }} [/SYS]"
    "{% else %}[ROLE] {{ m.role | escape }}[TEXT]{{ m.text | escape }} [/ROLE]{% endif %}"
    "{% endfor %}"
)

#: A control string whose first character is followed by any number of backslashes.
MARKED = re.compile("|".join(re.escape(c[0]) + r"\\*" + re.escape(c[1:]) for c in sorted(CONTROLS, key=len, reverse=True)))
ESCAPED = re.compile("|".join(re.escape(c[0]) + r"\\+" + re.escape(c[1:]) for c in sorted(CONTROLS, key=len, reverse=True)))


def escape(text: str) -> str:
    """One more backslash inside each control string, so that none is left; unescape takes it out again."""
    return MARKED.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


class TemplateError(ValueError):
    pass


class Undefined:
    def __bool__(self) -> bool:
        return False

    def __str__(self) -> str:
        return ""


UNDEFINED = Undefined()


def on_numbers(function: Callable) -> Callable:
    """Arithmetic that could make texts of any length is for numbers alone."""

    def run(a: object, b: object) -> object:
        if not all(isinstance(x, (int, float)) for x in (a, b)):
            raise TemplateError("an operation on numbers has other operands")
        return function(a, b)

    return run


def failed(text: object) -> None:
    raise TemplateError(str(text))


def bounded_range(*ends: object) -> range:
    out = range(*ends)
    return out if len(out) <= MOST_RANGE else failed(f"a range of {len(out)}")


def replaced(text: str, old: str, new: str) -> str:
    """Its length is known before it is made."""
    if len(text) + text.count(old) * (len(new) - len(old)) > MOST_TEXT:
        failed("a text that is too long")
    return text.replace(old, new)


def joined(values: object, between: str = "") -> str:
    parts = [str(v) for v in values]
    if sum(map(len, parts)) + len(str(between)) * len(parts) > MOST_TEXT:
        failed("a text that is too long")
    return str(between).join(parts)


def by_field(values: object, name: str, test: str = "", other: object = None) -> list:
    """The values whose field is true, or passes a test by name."""
    tests = {"equalto": operator.eq, "eq": operator.eq, "==": operator.eq, "ne": operator.ne, "in": lambda a, b: a in b}
    if test in tests:
        return [v for v in values if tests[test](field(v, name), other)]
    if test in TESTS:
        return [v for v in values if TESTS[test](field(v, name))]
    return [v for v in values if field(v, name)] if not test else failed(f"no test {test!r}")


FILTERS: dict[str, Callable] = {
    "escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower, "length": len, "string": str, "first": lambda x: x[0], "last": lambda x: x[-1],
    "default": lambda x, other="": other if x is UNDEFINED else x, "join": joined, "replace": replaced,
    "tojson": lambda x: json.dumps(x, ensure_ascii=False), "selectattr": by_field, "rejectattr": lambda xs, *a: [x for x in xs if x not in by_field(xs, *a)], "list": list, "reverse": lambda x: x[::-1],
}
FUNCTIONS: dict[str, Callable] = {"raise_exception": failed, "namespace": lambda **own: own, "range": lambda *a: bounded_range(*a)}
METHODS = frozenset("strip lstrip rstrip upper lower startswith endswith split title".split())
#: Of mappings, as lists.
MAPPING_METHODS: dict[str, Callable] = {"items": lambda x: [list(p) for p in x.items()], "keys": lambda x: list(x), "values": lambda x: list(x.values()), "get": lambda x, *a: x.get(*a)}
TESTS: dict[str, Callable] = {
    "defined": lambda x: x is not UNDEFINED, "undefined": lambda x: x is UNDEFINED, "none": lambda x: x is None, "string": lambda x: isinstance(x, str), "mapping": lambda x: isinstance(x, dict),
    "number": lambda x: isinstance(x, (int, float)), "sequence": lambda x: isinstance(x, (list, tuple, str)), "iterable": lambda x: isinstance(x, (list, tuple, str, dict)),
    "true": lambda x: x is True, "false": lambda x: x is False, "odd": lambda x: x % 2 == 1, "even": lambda x: x % 2 == 0,
}
NAMED = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
COMPARE = {ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge, ast.In: lambda a, b: a in b, ast.NotIn: lambda a, b: a not in b}
BINARY = {
    ast.Add: operator.add, ast.Sub: on_numbers(operator.sub), ast.Mult: on_numbers(operator.mul), ast.Div: on_numbers(operator.truediv), ast.FloorDiv: on_numbers(operator.floordiv),
    ast.Mod: on_numbers(operator.mod), ast.BitAnd: lambda a, b: str(a) + str(b),
}


class Value:
    """An expression: a closure over the variables, or a constant. uses: the variables and loop fields it looks at."""

    def __init__(self, run: Callable[[dict], object] | None = None, constant: object = None, uses: frozenset[str] = frozenset(), plain: str | None = None):
        #: plain: the variable that the expression is, if it is nothing more.
        self.run, self.constant, self.uses, self.plain = run, constant, uses, plain

    @property
    def fixed(self) -> bool:
        return self.run is None

    def __call__(self, scope: dict) -> object:
        return self.constant if self.run is None else self.run(scope)


#: What an operation of a template may fail with.
FAULTS = (TypeError, LookupError, AttributeError, ArithmeticError, RecursionError, ValueError)
#: Characters of a text that an operation may make, while compiling and while rendering, and items of a range.
MOST_CONSTANT, MOST_TEXT, MOST_RANGE = 1 << 16, 1 << 26, 100_000


def made(function: Callable, values: list, most: int) -> object:
    """function of values; any fault, and a text of more than `most` characters, is a TemplateError."""
    try:
        out = function(*values)
    except TemplateError:
        raise
    except FAULTS as e:
        raise TemplateError(f"{type(e).__name__}: {e}") from e
    if isinstance(out, str) and len(out) > max(most, *[len(v) for v in values if isinstance(v, str)], 0):
        raise TemplateError(f"a text of {len(out)} characters")
    return out


def folded(function: Callable, *parts: Value) -> Value:
    if all(p.fixed for p in parts):
        return Value(constant=made(function, [p.constant for p in parts], MOST_CONSTANT))
    return Value(lambda scope: made(function, [p(scope) for p in parts], MOST_TEXT), uses=frozenset().union(*[p.uses for p in parts]))


def field(owner: object, name: object) -> object:
    if isinstance(owner, dict):
        return owner.get(name, UNDEFINED)
    if isinstance(owner, (list, tuple, str)) and isinstance(name, (int, slice)):
        try:
            return owner[name]
        except IndexError:
            return UNDEFINED
    raise TemplateError(f"no field {name!r}")


#: Filters bind closer than arithmetic, and ~ less close; Python's operators that do so stand in for them.
STAND_INS = {"|": "**", "~": "&"}
NO_NAME = "not_defined"


def expression(source: str) -> Value:
    return compiled(parsed(source, "{}", "{} else " + NO_NAME))  # a conditional may lack its other side


def parsed(source: str, *forms: str) -> ast.expr:
    """The syntax tree of source put into the first of forms that makes it one."""
    try:
        parts = [(t.type, t.string) for t in tokenize.generate_tokens(io.StringIO(source.strip().replace("\n", " ")).readline)]
        if any(kind == tokenize.OP and text in STAND_INS.values() for kind, text in parts):
            raise TemplateError(f"not allowed in a template: {source!r}")
        changed = [(kind, STAND_INS.get(text, text) if kind == tokenize.OP else text) for kind, text in parts]
        plain = tokenize.untokenize(changed).strip()
        for form in forms[:-1]:
            try:
                return ast.parse(form.replace("{}", plain), mode="eval").body
            except SyntaxError:
                continue
        return ast.parse(forms[-1].replace("{}", plain), mode="eval").body
    except (SyntaxError, tokenize.TokenError, RecursionError, MemoryError) as e:
        raise TemplateError(f"not an expression: {source!r}") from e


def loop_of(source: str) -> tuple[list[str], Value, list[Value]]:
    """The variables, the items and the conditions of `x in xs`, `k, v in xs` and `x in xs if condition`."""
    tree = parsed(source, "[0 for {}]")
    match tree:
        case ast.ListComp(generators=[ast.comprehension(target=ast.Name(id=name), iter=items, ifs=tests, is_async=0)]):
            return [name], compiled(items), [compiled(t) for t in tests]
        case ast.ListComp(generators=[ast.comprehension(target=ast.Tuple(elts=elts), iter=items, ifs=tests, is_async=0)]) if all(isinstance(e, ast.Name) for e in elts):
            return [e.id for e in elts], compiled(items), [compiled(t) for t in tests]
    raise TemplateError(f"not a loop: {source!r}")


def filtered(value: Value, node: ast.expr) -> Value:
    """value after the filter, or the chain of filters, in node."""
    match node:
        case ast.BinOp(left=first, op=ast.Pow(), right=rest):
            return filtered(filtered(value, first), rest)
        case ast.Name(id=name) if name in FILTERS:
            return folded(FILTERS[name], value)
        case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if name in FILTERS:
            return folded(FILTERS[name], value, *map(compiled, args))
    raise TemplateError(f"no filter: {ast.unparse(node)}")


def compiled(node: ast.expr) -> Value:
    match node:
        case ast.Constant(value=str() | int() | float() | bool() | None as value):
            return Value(constant=value)
        case ast.Name(id=name) if name in NAMED:
            return Value(constant=NAMED[name])
        case ast.Name(id=name):
            return Value(lambda scope: scope.get(name, UNDEFINED), uses=frozenset({name}), plain=name)
        case ast.Attribute(value=owner, attr=name) if not name.startswith("_"):
            out = folded(field, compiled(owner), Value(constant=name))
            return Value(out.run, out.constant, out.uses | {f"loop.{name}"}) if isinstance(owner, ast.Name) and owner.id == "loop" else out
        case ast.Subscript(value=owner, slice=ast.Slice(lower=low, upper=high, step=step)):
            return folded(lambda x, a, b, c: field(x, slice(a, b, c)), compiled(owner), *[compiled(x) if x else Value() for x in (low, high, step)])
        case ast.Subscript(value=owner, slice=key):
            return folded(field, compiled(owner), compiled(key))
        case ast.List(elts=elts) | ast.Tuple(elts=elts):
            return folded(lambda *xs: list(xs), *map(compiled, elts))
        case ast.Dict(keys=keys, values=values) if all(keys):
            return folded(lambda *xs: dict(zip(xs[: len(keys)], xs[len(keys) :])), *map(compiled, (*keys, *values)))
        case ast.BinOp(left=left, op=ast.Pow(), right=right):
            return filtered(compiled(left), right)
        case ast.BinOp(left=left, op=op, right=right) if type(op) in BINARY:
            return folded(BINARY[type(op)], compiled(left), compiled(right))
        case ast.UnaryOp(op=ast.Not(), operand=x):
            return folded(operator.not_, compiled(x))
        case ast.UnaryOp(op=ast.USub(), operand=x):
            return folded(operator.neg, compiled(x))
        case ast.Compare(left=left, ops=[ast.Is() | ast.IsNot() as op], comparators=[ast.Name(id=name)]) if name in TESTS:
            return folded((lambda x: TESTS[name](x)) if isinstance(op, ast.Is) else (lambda x: not TESTS[name](x)), compiled(left))
        case ast.Compare(left=left, ops=[ast.Is() | ast.IsNot() as op], comparators=[ast.Constant(value=None)]):
            return folded((lambda x: x is None) if isinstance(op, ast.Is) else (lambda x: x is not None), compiled(left))
        case ast.Compare(left=left, ops=[op], comparators=[right]) if type(op) in COMPARE:
            return folded(COMPARE[type(op)], compiled(left), compiled(right))
        case ast.BoolOp(op=op, values=values):
            return decided([compiled(v) for v in values], isinstance(op, ast.And))
        case ast.IfExp(test=test, body=body, orelse=other):
            t, a, b = compiled(test), compiled(body), compiled(other)
            if t.fixed:
                return a if t.constant else b
            return Value(lambda scope: a(scope) if t(scope) else b(scope), uses=t.uses | a.uses | b.uses)
        case ast.Call(func=ast.Name(id=name), args=args, keywords=keywords) if name in FUNCTIONS and (name == "namespace" or not keywords):
            parts, named = [compiled(a) for a in args], {k.arg: compiled(k.value) for k in keywords}
            uses = frozenset({name}).union(*[p.uses for p in (*parts, *named.values())])
            return Value(lambda scope: made(lambda *own: FUNCTIONS[name](*own, **{k: v(scope) for k, v in named.items()}), [p(scope) for p in parts], MOST_TEXT), uses=uses)
        case ast.Call(func=ast.Attribute(value=owner, attr=name), args=args, keywords=[]) if name in MAPPING_METHODS:
            return folded(lambda x, *rest: MAPPING_METHODS[name](x, *rest) if isinstance(x, dict) else failed(f"{name} is for mappings"), compiled(owner), *map(compiled, args))
        case ast.Call(func=ast.Attribute(value=owner, attr=name), args=args, keywords=[]) if name in METHODS:
            return folded(lambda x, *rest: getattr(x, name)(*rest) if isinstance(x, str) else failed(f"{name} is for texts"), compiled(owner), *map(compiled, args))
    raise TemplateError(f"not allowed in a template: {ast.unparse(node)}")


def decided(parts: list[Value], every: bool) -> Value:
    """and, or: the operand that decides."""

    def run(scope: dict) -> object:
        for p in parts[:-1]:
            value = p(scope)
            if bool(value) != every:
                return value
        return parts[-1](scope)

    return Value(constant=run({})) if all(p.fixed for p in parts) else Value(run, uses=frozenset().union(*[p.uses for p in parts]))


class Output:
    def __init__(self, length: int = 0) -> None:
        self.parts: list[str] = []
        self.length = length
        self.spans: list[tuple[int, int]] = []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


Step = Callable[[dict, Output], None]


def sequence(steps: list[Step | str]) -> Step:
    """Neighbouring constant texts become one write."""
    joined: list[Step | str] = []
    for s in steps:
        if isinstance(s, str) and joined and isinstance(joined[-1], str):
            joined[-1] += s
        elif s != "":
            joined.append(s)
    ready = [(lambda scope, out, s=s: out.write(s)) if isinstance(s, str) else s for s in joined]

    def run(scope: dict, out: Output) -> None:
        for step in ready:
            step(scope, out)

    return run


def loop_fields(i: int, n: int | None = None) -> dict:
    return {"index0": i, "index": i + 1, "first": i == 0} | ({} if n is None else {"last": i == n - 1, "length": n})


def looped(names: list[str], source: Value, tests: list[Value], body: Step) -> Step:
    def run(scope: dict, out: Output) -> None:
        items = source(scope)
        if not isinstance(items, (list, tuple, range, dict)):
            raise TemplateError(f"a loop over {type(items).__name__}")
        bound = []
        for item in items:
            values = [item] if len(names) == 1 else item
            if len(names) > 1 and not (isinstance(values, (list, tuple)) and len(values) == len(names)):
                raise TemplateError(f"no {len(names)} values in {item!r}")
            own = dict(zip(names, values))
            if all(t(scope | own) for t in tests):
                bound.append(own)
        for i, own in enumerate(bound):
            body(scope | own | {"loop": loop_fields(i, len(bound))}, out)

    return run


def chosen(branches: list[tuple[Value, Step]]) -> Step | str:
    """Branches of constant conditions are settled here."""
    live: list[tuple[Value, Step]] = []
    for test, body in branches:
        if test.fixed and not test.constant:
            continue
        live.append((test, body))
        if test.fixed:
            break
    if not live:
        return ""

    def run(scope: dict, out: Output) -> None:
        for test, body in live:
            if test(scope):
                return body(scope, out)

    return live[0][1] if live[0][0].fixed else run


def masked(body: Step) -> Step:
    def run(scope: dict, out: Output) -> None:
        start = out.length
        body(scope, out)
        out.spans.append((start, out.length))

    return run


def assigned(name: str, part: str | None, value: Value) -> Step:
    def run(scope: dict, out: Output) -> None:
        if part is None:
            scope[name] = value(scope)
        elif isinstance(scope.get(name), dict):
            scope[name][part] = value(scope)
        else:
            raise TemplateError(f"{name} has no fields")

    return run


def captured(name: str, body: Step) -> Step:
    """The text of a block as a variable."""

    def run(scope: dict, out: Output) -> None:
        own = Output()
        body(scope, own)
        if own.spans:
            raise TemplateError("a generation inside a set block")
        scope[name] = "".join(own.parts)

    return run


#: A raw block, an expression, a tag or a comment; what stands in quotes closes none.
_INNER = r"""(?:[^'"%}]|'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*"|%(?!\})|\}(?!\}))*?"""
TAG = re.compile(rf"\{{%(-?)\s*raw\s*(?:-?)%\}}(?P<raw>.*?)\{{%-?\s*endraw\s*(-?)%\}}|\{{\{{(-?)(?P<value>{_INNER})(-?)\}}\}}|\{{%(-?)(?P<tag>{_INNER})(-?)%\}}|\{{#(-?)(?:.*?)(-?)#\}}", re.S)


def tokens_of(source: str) -> list[tuple[str, str]]:
    """(text, value or tag, its content); white space beside a mark with a minus is left out."""
    out: list[tuple[str, str]] = []
    at, strip = 0, False
    for m in [*TAG.finditer(source), None]:
        text = source[at : m.start() if m else len(source)]
        if re.search(r"\{\{|\{%", text):
            raise TemplateError(f"a mark without an end: {text!r}")
        if m is None:
            return [*out, ("text", text.lstrip() if strip else text)]
        minus = [g for i, g in enumerate(m.groups(), 1) if g is not None and i not in (TAG.groupindex[k] for k in ("raw", "value", "tag"))]
        text = text.lstrip() if strip else text
        out.append(("text", text.rstrip() if minus[0] else text))
        for kind in ("raw", "value", "tag"):
            if m[kind] is not None:
                out.append(("text" if kind == "raw" else kind, m[kind].strip() if kind == "tag" else m[kind]))
        at, strip = m.end(), bool(minus[-1])


class Template:
    """A compiled template. by_turn: (before, loop variable, body, after) if each message is rendered by itself."""

    def __init__(self, body: Step, by_turn: tuple[Step, str, Step, Step] | None):
        self.body, self.by_turn = body, by_turn

    def __call__(self, messages: list[dict]) -> tuple[str, list[tuple[int, int]]]:
        out = Output()
        self.body({"messages": messages}, out)
        return "".join(out.parts), out.spans


#: What a loop's body may look at, besides its variable, to be rendered turn by turn.
OF_ONE_TURN = frozenset({"loop", "loop.index", "loop.index0", "loop.first"})


def compile_template(source: str) -> Template:
    """A function of messages that gives the text and the spans of it that were generated."""
    tokens = tokens_of(source)
    place = 0
    uses: set[str] = set()  # by what is being compiled

    def value_of(text: str) -> Value:
        value = expression(text)
        uses.update(value.uses)
        return value

    def block(*ends: str) -> tuple[list[Step | str], str]:
        """Steps up to one of the tags in ends, and that tag."""
        nonlocal place, uses
        steps: list[Step | str] = []
        while place < len(tokens):
            kind, text = tokens[place]
            place += 1
            word = text.split(None, 1)[0] if kind == "tag" and text else ""
            if kind == "text":
                steps.append(text)
            elif kind == "value":
                value = value_of(text)
                steps.append(str(value.constant) if value.fixed else lambda scope, out, v=value: out.write(str(v(scope))))
            elif word in ends:
                return steps, text
            elif word == "for":
                names, items, tests = loop_of(text[3:])
                uses.update(items.uses, *[t.uses for t in tests])
                outer, uses = uses, set()
                body = sequence(block("endfor")[0])
                step = looped(names, items, tests, body)
                whole = len(names) == 1 and not tests and items.plain == "messages"
                step.turns = (names[0], body) if whole and uses <= OF_ONE_TURN | set(names) else None
                uses = outer | uses
                steps.append(step)
            elif word == "if":
                branches, test = [], text[2:]
                while test is not None:
                    condition = value_of(test)
                    body, end = block("elif", "else", "endif")
                    branches.append((condition, sequence(body)))
                    test = end[4:] if end.startswith("elif") else None
                if end == "else":
                    branches.append((Value(constant=True), sequence(block("endif")[0])))
                steps.append(chosen(branches))
            elif word == "generation":
                steps.append(masked(sequence(block("endgeneration")[0])))
            elif word == "set" and re.fullmatch(r"set\s+[A-Za-z_]\w*", text):
                uses.add("set")
                steps.append(captured(text.split()[1], sequence(block("endset")[0])))
            elif word == "set" and (m := re.fullmatch(r"set\s+([A-Za-z_]\w*)(?:\.([A-Za-z]\w*))?\s*=\s*(.+)", text, re.S)):
                uses.add("set")
                steps.append(assigned(m[1], m[2], value_of(m[3])))
            else:
                raise TemplateError(f"unexpected tag: {text!r}")
        if ends:
            raise TemplateError(f"missing {' or '.join(ends)}")
        return steps, ""

    steps, _ = block()
    steps = [s for s in steps if s != ""]
    loops = [i for i, s in enumerate(steps) if getattr(s, "turns", None)]
    by_turn = None
    if len(loops) == 1 and all(isinstance(s, str) for i, s in enumerate(steps) if i != loops[0]):
        k = loops[0]
        by_turn = (sequence(steps[:k]), *steps[k].turns, sequence(steps[k + 1 :]))
    return Template(sequence(steps), by_turn)


def read_back(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a text, or of whole turns of one, that TEMPLATE made."""
    turns, at = [], len("<s>") * text.startswith("<s>")
    kinds = (("[INST] ", " [/INST]", "user"), ("[SYS] ", " [/SYS]", "system"), ("[ROLE] ", " [/ROLE]", None), (" ", "</s>", "assistant"))
    while at < len(text):
        for start, end, role in kinds:
            if text.startswith(start, at):
                stop = text.index(end, at + len(start))
                body = text[at + len(start) : stop]
                if role is None:
                    role, _, body = body.partition("[TEXT]")
                    role = unescape(role)
                turns.append((role, unescape(body)))
                at = stop + len(end)
                break
        else:
            raise ValueError(f"no turn at {at}")
    return turns


PARTS = "conv_id long, part long, start long, text string, loss_spans array<struct<start: long, end: long>>"
NOTHING = object()


def rendered(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """PARTS: the texts of conversations in pieces of a turn each, in order within a partition. start is the
    piece's place in its conversation, loss_spans are places there, too."""
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        program = compile_template(template)
        made: list[tuple] = []
        conv, part, length, held = NOTHING, 0, 0, []

        def put(step: Step, scope: dict) -> None:
            nonlocal part, length
            out = Output(length)
            step(scope, out)
            if out.length > length:
                made.append((conv, part, length, "".join(out.parts), [{"start": a, "end": b} for a, b in out.spans]))
                part, length = part + 1, out.length

        def ended() -> None:
            if conv is NOTHING:
                return
            if program.by_turn:
                put(program.by_turn[3], {})
            else:
                put(program.body, {"messages": held})

        def taken() -> pa.RecordBatch:
            columns = list(zip(*made)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            made.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["conv_id", "part", "start", "text", "loss_spans"])

        for batch in batches:
            for own, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "role", "text"))):
                if conv is NOTHING or own != conv:
                    ended()
                    conv, part, length, held, turn = own, 0, 0, [], 0
                message = {"role": role, "text": text, "content": text}
                if program.by_turn:
                    before, name, body, _ = program.by_turn
                    first = (lambda scope, out: (before(scope, out), body(scope, out))) if turn == 0 else body
                    put(first, {name: message, "loop": loop_fields(turn)})
                else:
                    held.append(message)
                turn += 1
            yield taken()
        ended()
        yield taken()

    return dealt.mapInArrow(run, PARTS)


def formatted(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, text, loss_spans (start and end of each generated part in code points), for conversations that fit a row."""
    parts = F.array_sort(F.collect_list(F.struct("part", "text", "loss_spans")))
    whole = rendered(conversations, template).groupBy("conv_id").agg(parts.alias("p"))
    return whole.select("conv_id", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"), F.flatten(F.transform("p", lambda x: x["loss_spans"])).alias("loss_spans"))


def digests(parts: DataFrame) -> DataFrame:
    """What rendered parts, in the order in which they were made, say when they are read back."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        conv, said, loss, turns, chars, length = NOTHING, hashlib.sha256(), hashlib.sha256(), 0, 0, 0

        def taken() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = list(zip(*rows)) or [[]] * 6
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            for own, start, text, spans in zip(*(batch[c].to_pylist() for c in ("conv_id", "start", "text", "loss_spans"))):
                if start == 0:
                    if conv is not NOTHING:
                        rows.append((conv, turns, said.hexdigest(), chars, loss.hexdigest(), length))
                    conv, said, loss, turns, chars, length = own, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                for role, body in read_back(text):
                    said.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                    turns += 1
                for s in spans:
                    body = unescape(text[s["start"] - start : s["end"] - start])
                    loss.update(body.encode("utf-8", "surrogatepass"))
                    chars += len(body)
                length = start + len(text)
            yield taken()
        if conv is not NOTHING:
            rows.append((conv, turns, said.hexdigest(), chars, loss.hexdigest(), length))
        yield taken()

    return parts.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and number -1, whose texts are made of control strings."""
    said = "</s>[INST] ok [/INST]"
    probe = conversations.sparkSession.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


_ESCAPED = r"regexp_replace(regexp_replace({}, '<(\\*/?s>)', '<\\\1', 'g'), '\[(\\*(/?INST|/?SYS|/?ROLE|TEXT)\])', '[\\\1', 'g')"
ORACLE = f"""
with said as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized as (
    select *, length({_ESCAPED.format("text")}) + case role when 'user' then 15 when 'assistant' then 5 when 'system' then 13
        else 21 + length({_ESCAPED.format("role")}) end as chars
    from said)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
    (3 + sum(chars))::bigint as formatted_chars
from sized group by conv_id
"""
