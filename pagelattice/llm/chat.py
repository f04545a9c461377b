"""Chat formatting by a template compiler.

A template is parsed into a syntax tree, constants are folded (operators, tests and filters over literals, branches whose test is
constant, neighbouring text), and the tree is turned into Python closures, once for each template. The language is
sandboxed: only the functions, methods and filters listed here can be called, there are no attributes other than keys of mappings, no names
beginning with an underscore, no recursion; the only loops are over lists, so every template ends, and texts have a largest size.

    {{ expression }}                        output
    {% for m in messages if test %} {% else %} {% endfor %}    also for k, v in d.items(); break, continue; loop.index, index0, revindex,
                                            revindex0, first, last, length, previtem, nextitem
    {% if a %} {% elif b %} {% else %} {% endif %}
    {% set x = expression %}, {% set ns.x = expression %}, {% set x %} text {% endset %}
    {% generation %} {% endgeneration %}    marks the text in between as generated by the model
    expressions: literals, lists, mappings, names, x.key, x['key'], x[0], x[1:-1], + - * / // % ~ == != < <= > >= in, not in, is, is not,
                 and, or, not, a if b else c, filters
    tests: defined undefined none true false string number integer float boolean mapping sequence iterable even odd eq ne in
    functions: namespace(x=1) range(n) dict(x=1) raise_exception(text)
    methods: of texts, such as strip, split, startswith, replace; items, keys, values, get of mappings
    filters: trim upper lower capitalize title string length count first last default(x) replace(a, b) join(x) tojson(indent) items list
             int float abs reverse sort unique min max sum indent map select reject selectattr rejectattr safe
    a minus sign inside a tag's brackets takes away the white space beside it

compile_template's `blocks` reads templates as those published with models are read: the line end after a tag and the blanks before one that
begins a line go. A name that is set in a loop is forgotten with the round; namespaces keep what is set.

Rendering gives the text and the character ranges of the generation marks.

Defined cases: a message with null role or text has empty strings there; turns are sorted by number, nulls first, ties by role
and then text; repeated rows are repeated messages; a null conv_id is a conversation of its own; extra columns are ignored, whatever their names; an
unknown name is an empty string and false; a conversation that the template refuses (raise_exception, an operation on a value of the wrong
kind) has null rendered and generated; an empty table gives an empty table; very long texts are rendered whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHATML = """{% for m in messages %}<|im_start|>{{ m.role }}
{% if m.role == 'assistant' %}{% generation %}{{ m.text }}<|im_end|>{% endgeneration %}
{% else %}{{ m.text }}<|im_end|>
{% endif %}{% endfor %}"""


class TemplateError(ValueError):
    """A template that can't be compiled or a value that an operation can't take."""


#: Characters of a text, and items of a range, at most.
LONGEST, RANGE = 1 << 29, 1 << 16
_TAG = re.compile(r"\{\{[-+]?|\{%[-+]?|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"\s*(?:(\d+\.\d+|\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|<=|>=|//|[-+*/%~<>=|.,:()\[\]{}]))", re.S)
_WORDS = {"and", "or", "not", "in", "is", "if", "else", "true", "false", "none", "True", "False", "None"}
_CONSTANTS = {"true": True, "false": False, "none": None}


def _chunks(source: str, blocks: bool = False):
    """("text", s), ("out", s) and ("tag", s)."""
    at, strip, line = 0, False, False
    while True:
        m = _TAG.search(source, at)
        text = source[at : m.start() if m else len(source)]
        if strip:
            text = text.lstrip()
        elif line:
            text = text.removeprefix("\n")
        if m and m[0].endswith("-"):
            text = text.rstrip()
        elif blocks and m and m[0] != "{{" and not m[0].endswith("+") and (begin := re.search(r"(?:^|\n)[ \t]*$", source[: m.start()])):
            kept = len(text) - (m.start() - begin.end() + len(begin[0].lstrip("\n")))
            text = text[: max(0, kept)]
        if text:
            yield "text", text
        if not m:
            return
        if m[0].startswith("{#"):
            at, strip, line = m.end(), m[0].endswith("-#}"), blocks
            continue
        close = "}}" if m[0].startswith("{{") else "%}"
        end, quote, depth = m.end(), "", 0
        while end < len(source) and (quote or depth or not source.startswith(close, end)):
            c = source[end]
            if quote:
                if c == "\\":
                    end += 1
                elif c == quote:
                    quote = ""
            elif c in "'\"":
                quote = c
            elif c in "([{":
                depth += 1
            elif c in ")]}":
                depth = max(0, depth - 1)
            end += 1
        if end >= len(source):
            raise TemplateError(f"no {close} after position {m.start()}")
        body = source[m.end() : end]
        strip = body.endswith("-")
        line = blocks and close == "%}" and not body.endswith("+")
        yield ("out" if close == "}}" else "tag"), body[:-1] if body[-1:] in ("-", "+") else body
        at = end + 2


class _Expression:
    """Recursive descent over one expression; nodes are tuples (kind, ...)."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            number, string, name, op = m.groups()
            if number:
                self.tokens.append(("const", float(number) if "." in number else int(number)))
            elif string:
                self.tokens.append(("const", re.sub(r"\\(.)", lambda k: {"n": "\n", "t": "\t", "r": "\r"}.get(k[1], k[1]), string[1:-1], flags=re.S)))
            elif name:
                if name.startswith("_"):
                    raise TemplateError(f"the name {name} isn't allowed")
                self.tokens.append(("word" if name in _WORDS else "name", name))
            else:
                self.tokens.append(("op", op))
            at = m.end()
        self.at = 0

    def peek(self, *values: str, ahead: int = 0) -> bool:
        k = self.at + ahead
        return k < len(self.tokens) and self.tokens[k][0] in ("op", "word") and self.tokens[k][1] in values

    def take(self, *values: str) -> str | None:
        if self.peek(*values):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value} is missing")

    def word(self, kinds: tuple[str, ...] = ("name",)) -> str:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        if kind not in kinds:
            raise TemplateError("a name is missing")
        self.at += 1
        return value

    def end(self, out):
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def whole(self):
        return self.end(self.ternary())

    def rows(self):
        """(the list, the test or None) of a loop."""
        value = self.logic(0)
        if self.take("if"):
            test = self.logic(0)
            if not self.take("else"):
                return self.end((value, test))
            value = fold(("choose", test, value, self.ternary()))
        return self.end((value, None))

    def ternary(self):
        value = self.logic(0)
        if self.take("if"):
            test = self.logic(0)
            other = self.ternary() if self.take("else") else ("const", "")
            return fold(("choose", test, value, other))
        return value

    LEVELS = (("or",), ("and",), ("not",), ("==", "!=", "<", "<=", ">", ">=", "in", "not", "is"), ("~", "+", "-"), ("*", "/", "//", "%"))

    def logic(self, level: int):
        if level == len(self.LEVELS):
            return self.postfix()
        if self.LEVELS[level] == ("not",):
            if self.take("not"):
                return fold(("not", self.logic(level)))
            return self.logic(level + 1)
        left = self.logic(level + 1)
        while self.peek(*self.LEVELS[level]):
            if self.peek("not") and not self.peek("in", ahead=1):
                break
            op = self.take(*self.LEVELS[level])
            if op == "not":
                self.need("in")
                left = fold(("not", fold(("in", left, self.logic(level + 1)))))
            elif op == "is":
                left = self.test(left, level)
            else:
                left = fold((op, left, self.logic(level + 1)))
        return left

    def test(self, left, level: int):
        negated = self.take("not")
        name = "in" if self.take("in") else self.word(("name", "word"))
        name = {"equalto": "eq"}.get(name.lower(), name.lower())
        if name not in TESTS:
            raise TemplateError(f"no test {name!r}")
        args = []
        if name in _TWO:
            args = [self.logic(level + 1)]
        elif self.take("("):
            self.need(")")
        node = ("test", "defined" if name == "undefined" else name, left, *args)
        return fold(("not", fold(node))) if bool(negated) != (name == "undefined") else fold(node)

    def arguments(self) -> tuple[list, tuple]:
        """(nodes, (name, node) pairs) up to the closing bracket."""
        args, named = [], []
        while not self.take(")"):
            if self.at >= len(self.tokens):
                raise TemplateError(") is missing")
            if self.tokens[self.at][0] == "name" and self.peek("=", ahead=1):
                name = self.word()
                self.need("=")
                named.append((name, self.ternary()))
            else:
                args.append(self.ternary())
            if not self.peek(")"):
                self.need(",")
        return args, tuple(named)

    def postfix(self):
        out = self.atom()
        while True:
            if self.take("."):
                name = self.word()
                if self.take("("):
                    if name not in METHODS:
                        raise TemplateError(f"no method {name!r}")
                    args, named = self.arguments()
                    if named:
                        raise TemplateError("methods take no names")
                    out = fold(("method", name, out, *args))
                else:
                    out = fold(("key", out, ("const", name)))
            elif self.take("["):
                out = self.place(out)
            elif self.take("|"):
                name = self.word()
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                args, named = self.arguments() if self.take("(") else ([], ())
                out = fold(("filter", name, named, out, *args)) if not named else ("filter", name, named, out, *args)
            elif self.peek("("):
                raise TemplateError("such calls aren't allowed")
            else:
                return out

    def place(self, out):
        """x[0], x['key'] or x[a:b:c], after the bracket."""
        none, parts = ("const", None), []
        while True:
            parts.append(none if self.peek(":", "]") else self.ternary())
            if not self.take(":"):
                break
        self.need("]")
        if len(parts) == 1:
            if parts[0] is none:
                raise TemplateError("an expression is missing")
            return fold(("key", out, parts[0]))
        if len(parts) > 3:
            raise TemplateError("a slice has three parts at most")
        return fold(("slice", out, *parts, *[none] * (3 - len(parts))))

    def atom(self):
        if self.take("("):
            out = self.ternary()
            if self.peek(","):
                items = [out]
                while self.take(",") and not self.peek(")"):
                    items.append(self.ternary())
                out = fold(("list", *items))
            self.need(")")
            return out
        if self.take("["):
            items = []
            while not self.take("]"):
                items.append(self.ternary())
                if not self.peek("]"):
                    self.need(",")
            return fold(("list", *items))
        if self.take("{"):
            items = []
            while not self.take("}"):
                items.append(self.ternary())
                self.need(":")
                items.append(self.ternary())
                if not self.peek("}"):
                    self.need(",")
            return fold(("dict", *items))
        if self.take("-"):
            return fold(("-", ("const", 0), self.postfix()))
        if self.at >= len(self.tokens):
            raise TemplateError("an expression is missing")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "const":
            return ("const", value)
        if kind == "word" and value.lower() in _CONSTANTS:
            return ("const", _CONSTANTS[value.lower()])
        if kind == "name":
            if self.take("("):
                if value not in FUNCTIONS:
                    raise TemplateError(f"no function {value!r}")
                args, named = self.arguments()
                return ("call", value, named, *args)
            return ("name", value)
        raise TemplateError(f"unexpected {value!r}")


class _Space:
    """A namespace: what is set in it stays."""

    def __init__(self, **values):
        self.values = values


def text_of(v) -> str:
    return "" if v is None else "true" if v is True else "false" if v is False else str(v)


def _bounded(s: str) -> str:
    if len(s) > LONGEST:
        raise TemplateError("a text grows too long")
    return s


def _whole(v, otherwise, kind):
    try:
        return kind(v)
    except (TypeError, ValueError, OverflowError):
        return otherwise


def _items(v) -> list:
    if not isinstance(v, dict):
        raise TemplateError("only mappings have items")
    return [[k, x] for k, x in v.items()]


def _list(v) -> list:
    if isinstance(v, (list, str)):
        return list(v)
    if isinstance(v, dict):
        return list(v)
    if v is None:
        return []
    raise TemplateError(f"{v!r} isn't a list")


def _unique(v) -> list:
    out: list = []
    for x in _list(v):
        if x not in out:
            out.append(x)
    return out


def _json(v, indent=None) -> str:
    return _bounded(json.dumps(v, ensure_ascii=False, indent=indent))


def _at(v, path):
    """v's value under a name with dots."""
    for k in text_of(path).split("."):
        v = _key(v, int(k) if k.isdigit() else k)
    return v


def _passes(v, test=None, *args) -> bool:
    if test is None:
        return bool(v)
    test = {"equalto": "eq", "==": "eq", "!=": "ne"}.get(test, test)
    if test in ("defined", "undefined"):
        return (v is not None) == (test == "defined")
    if test not in TESTS:
        raise TemplateError(f"no test {test!r}")
    return bool(TESTS[test](v, *args))


def _map(v, name=None, *args, attribute=None, default=None) -> list:
    if attribute is not None:
        return [default if (y := _at(x, attribute)) is None else y for x in _list(v)]
    if name not in FILTERS:
        raise TemplateError(f"no filter {name!r}")
    return [FILTERS[name](x, *args) for x in _list(v)]


def _indent(v, width=4, first=False) -> str:
    pad = " " * int(width)
    return _bounded((pad if first else "") + text_of(v).replace("\n", "\n" + pad))


FILTERS: dict[str, Callable] = {
    "trim": lambda v: text_of(v).strip(),
    "upper": lambda v: text_of(v).upper(),
    "lower": lambda v: text_of(v).lower(),
    "capitalize": lambda v: text_of(v).capitalize(),
    "title": lambda v: text_of(v).title(),
    "string": text_of,
    "safe": text_of,
    "length": lambda v: len(v) if isinstance(v, (str, list, dict)) else 0,
    "count": lambda v: len(v) if isinstance(v, (str, list, dict)) else 0,
    "first": lambda v: v[0] if isinstance(v, (str, list)) and v else "",
    "last": lambda v: v[-1] if isinstance(v, (str, list)) and v else "",
    "default": lambda v, d="", empty=False: d if v is None or v == "" or empty and not v else v,
    "replace": lambda v, a="", b="": _bounded(text_of(v).replace(text_of(a), text_of(b))) if a != "" else text_of(v),
    "join": lambda v, d="", attribute=None: _bounded(text_of(d).join(text_of(x if attribute is None else _at(x, attribute)) for x in v)) if isinstance(v, list) else text_of(v),
    "tojson": _json,
    "items": _items,
    "list": _list,
    "int": lambda v, d=0: _whole(v, d, int),
    "float": lambda v, d=0.0: _whole(v, d, float),
    "abs": lambda v: abs(_number(v)),
    "reverse": lambda v: v[::-1] if isinstance(v, (str, list)) else _list(v)[::-1],
    "sort": lambda v, reverse=False: sorted(_list(v), reverse=bool(reverse)),
    "unique": _unique,
    "min": lambda v: min(_list(v), default=None),
    "max": lambda v: max(_list(v), default=None),
    "sum": lambda v: sum(map(_number, _list(v))),
    "indent": _indent,
    "map": _map,
    "select": lambda v, *t: [x for x in _list(v) if _passes(x, *t)],
    "reject": lambda v, *t: [x for x in _list(v) if not _passes(x, *t)],
    "selectattr": lambda v, a, *t: [x for x in _list(v) if _passes(_at(x, a), *t)],
    "rejectattr": lambda v, a, *t: [x for x in _list(v) if not _passes(_at(x, a), *t)],
}


def _raise(text=""):
    raise TemplateError(text_of(text))


def _range(*args) -> list:
    r = range(*args)
    if len(r) > RANGE:
        raise TemplateError("a range is too long")
    return list(r)


FUNCTIONS: dict[str, Callable] = {"namespace": _Space, "dict": lambda **v: v, "range": _range, "raise_exception": _raise}
_OF_TEXT = frozenset("strip lstrip rstrip upper lower title capitalize startswith endswith split rsplit splitlines replace removeprefix removesuffix find count isdigit isalpha".split())
_OF_MAPPING = frozenset(("items", "keys", "values", "get"))
METHODS = _OF_TEXT | _OF_MAPPING
TESTS: dict[str, Callable] = {
    "defined": lambda v: v is not None,
    "undefined": lambda v: v is None,
    "none": lambda v: v is None,
    "true": lambda v: v is True,
    "false": lambda v: v is False,
    "boolean": lambda v: isinstance(v, bool),
    "string": lambda v: isinstance(v, str),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool),
    "float": lambda v: isinstance(v, float),
    "mapping": lambda v: isinstance(v, dict),
    "sequence": lambda v: isinstance(v, (str, list)),
    "iterable": lambda v: isinstance(v, (str, list, dict)),
    "even": lambda v: _number(v) % 2 == 0,
    "odd": lambda v: _number(v) % 2 == 1,
    "eq": lambda a, b: a == b,
    "ne": lambda a, b: a != b,
    "in": lambda a, b: OPERATORS["in"](a, b),
}
_TWO = ("eq", "ne", "in")


def _method(name: str, v, *args):
    if isinstance(v, str) and name in _OF_TEXT:
        out = getattr(v, name)(*args)
        return _bounded(out) if isinstance(out, str) else out
    if isinstance(v, dict) and name in _OF_MAPPING:
        return _items(v) if name == "items" else v.get(*args) if name == "get" else list(getattr(v, name)())
    raise TemplateError(f"{name} isn't a method of {v!r}")


def _checked(f: Callable) -> Callable:
    """f, whose errors over values of the wrong kind are the template's."""

    def run(*args, **named):
        try:
            return f(*args, **named)
        except (TypeError, ValueError, AttributeError, ZeroDivisionError, OverflowError) as e:
            raise e if isinstance(e, TemplateError) else TemplateError(str(e)) from None

    return run


def _key(v, k):
    if isinstance(v, dict):
        return v.get(k)
    if isinstance(v, _Space):
        return v.values.get(k)
    if isinstance(v, (list, str)) and isinstance(k, int) and not isinstance(k, bool) and -len(v) <= k < len(v):
        return v[k]
    return None


def _slice(v, a, b, c):
    if not isinstance(v, (str, list)):
        raise TemplateError(f"{v!r} has no parts")
    return v[a:b:c]


def _add(a, b):
    if isinstance(a, str) or isinstance(b, str):
        return _bounded(text_of(a) + text_of(b))
    if isinstance(a, list) and isinstance(b, list):
        if len(a) + len(b) > LONGEST >> 4:
            raise TemplateError("a list grows too long")
        return a + b
    return _number(a) + _number(b)


def _number(v):
    if isinstance(v, (int, float)):
        return v
    raise TemplateError(f"{v!r} isn't a number")


def _times(a, b):
    out = _number(a) * _number(b)
    if isinstance(out, int) and out.bit_length() > 1 << 12:
        raise TemplateError("a number grows too large")
    return out


def _ordered(f):
    def run(a, b):
        try:
            return f(a, b)
        except TypeError:
            return False

    return run


OPERATORS: dict[str, Callable] = {
    "+": _add,
    "~": lambda a, b: _bounded(text_of(a) + text_of(b)),
    "-": lambda a, b: _number(a) - _number(b),
    "*": _times,
    "/": _checked(lambda a, b: _number(a) / _number(b)),
    "//": _checked(lambda a, b: _number(a) // _number(b)),
    "%": _checked(lambda a, b: _number(a) % _number(b)),
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": _ordered(lambda a, b: a < b),
    "<=": _ordered(lambda a, b: a <= b),
    ">": _ordered(lambda a, b: a > b),
    ">=": _ordered(lambda a, b: a >= b),
    "in": _ordered(lambda a, b: a in b),
    "and": lambda a, b: a and b,
    "or": lambda a, b: a or b,
    "key": _key,
}


def fold(node):
    """The node's constant, if its parts are constants; a choice by a constant test is made."""
    kind, parts = node[0], [x for x in node[1:] if isinstance(x, tuple) and x]
    if kind == "choose" and node[1][0] == "const":
        return node[2] if node[1][1] else node[3]
    if kind in ("and", "or") and node[1][0] == "const":
        return (node[2] if node[1][1] else node[1]) if kind == "and" else (node[1] if node[1][1] else node[2])
    if kind not in ("const", "name", "call") and all(p[0] == "const" for p in parts):
        return ("const", _closure(node)({}))
    return node


def _defined(node) -> Callable[[dict], bool]:
    """Whether there is such a name or key."""
    if node[0] == "name":
        name = node[1]
        return lambda env: name in env
    if node[0] == "key":
        f, g = _closure(node[1]), _closure(node[2])

        def there(env):
            v, k = f(env), g(env)
            return k in (v.values if isinstance(v, _Space) else v) if isinstance(v, (dict, _Space)) else _key(v, k) is not None

        return there
    return lambda env: True


def _closure(node) -> Callable[[dict], object]:
    """A function of the variables that gives the expression's value."""
    kind = node[0]
    if kind == "const":
        value = node[1]
        return lambda env: value
    if kind == "name":
        name = node[1]
        return lambda env: env.get(name)
    if kind == "not":
        f = _closure(node[1])
        return lambda env: not f(env)
    if kind == "choose":
        test, a, b = map(_closure, node[1:])
        return lambda env: a(env) if test(env) else b(env)
    if kind in ("filter", "call"):
        g, named, fs = _checked((FILTERS if kind == "filter" else FUNCTIONS)[node[1]]), [(k, _closure(x)) for k, x in node[2]], [_closure(x) for x in node[3:]]
        if len(fs) == 1 and not named:
            f = fs[0]
            return lambda env: g(f(env))
        return lambda env: g(*(f(env) for f in fs), **{k: f(env) for k, f in named})
    if kind == "test":
        if node[1] == "defined":
            return _defined(node[2])
        g, fs = TESTS[node[1]], [_closure(x) for x in node[2:]]
        return lambda env: g(*(f(env) for f in fs))
    if kind == "method":
        g, name, fs = _checked(_method), node[1], [_closure(x) for x in node[2:]]
        return lambda env: g(name, *(f(env) for f in fs))
    if kind == "slice":
        g, fs = _checked(_slice), [_closure(x) for x in node[1:]]
        return lambda env: g(*(f(env) for f in fs))
    if kind == "list":
        fs = [_closure(x) for x in node[1:]]
        return lambda env: [f(env) for f in fs]
    if kind == "dict":
        fs = [_closure(x) for x in node[1:]]

        def build(env):
            keys = [f(env) for f in fs[::2]]
            if not all(isinstance(k, (str, int, float)) or k is None for k in keys):
                raise TemplateError("a mapping's keys are texts or numbers")
            return dict(zip(keys, (f(env) for f in fs[1::2])))

        return build
    a, b = _closure(node[1]), _closure(node[2])
    if kind == "and":
        return lambda env: a(env) and b(env)
    if kind == "or":
        return lambda env: a(env) or b(env)
    if kind == "key" and node[2][0] == "const" and isinstance(node[2][1], str):
        k = node[2][1]

        def get(env):
            v = a(env)
            return v.get(k) if isinstance(v, dict) else v.values.get(k) if isinstance(v, _Space) else None

        return get
    op = OPERATORS[kind]
    return lambda env: op(a(env), b(env))


def parse(source: str, blocks: bool = False) -> list:
    """The syntax tree: a list of ("text", s), ("out", e), ("for", names, e, test, body, else), ("if", [(test, body)...]), ("set", name, key, e), ("capture", name, body), ("generation", body), ("break",), ("continue",)."""
    chunks, at = list(_chunks(source, blocks)), 0

    def body(ends: tuple[str, ...], looped: bool):
        nonlocal at
        out: list = []

        def add(node):
            if node[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + node[1])
            elif node != ("text", ""):
                out.append(node)

        while at < len(chunks):
            kind, s = chunks[at]
            at += 1
            if kind == "text":
                add(("text", s))
            elif kind == "out":
                e = _Expression(s).whole()
                add(("text", text_of(e[1])) if e[0] == "const" else ("out", e))
            else:
                word, _, rest = re.sub(r"\s", " ", s.strip(), count=1).partition(" ") if re.match(r"\s*\w+\s", s) else (s.strip(), "", "")
                if word in ends:
                    return out, word, rest
                if word == "for":
                    m = re.fullmatch(r"\s*([A-Za-z]\w*(?:\s*,\s*[A-Za-z]\w*)*)\s+in\s+(.+)", rest, re.S)
                    if not m:
                        raise TemplateError(f"can't read for {rest}")
                    rows, test = _Expression(m[2]).rows()
                    inner, end, _ = body(("endfor", "else"), True)
                    none = body(("endfor",), looped)[0] if end == "else" else []
                    add(("for", re.split(r"\s*,\s*", m[1]), rows, test, inner, none))
                elif word == "if":
                    arms, test = [], _Expression(rest).whole()
                    while True:
                        inner, end, more = body(("elif", "else", "endif"), looped)
                        arms.append((test, inner))
                        if end == "endif":
                            break
                        test = _Expression(more).whole() if end == "elif" else ("const", True)
                    live = []
                    for test, inner in arms:  # arms that never run are left out
                        if test[0] != "const" or test[1]:
                            live.append((test, inner))
                        if test[0] == "const" and test[1]:
                            break
                    if live and live[0][0][0] == "const":
                        for node in live[0][1]:
                            add(node)
                    elif live:
                        add(("if", live))
                elif word == "set":
                    if m := re.fullmatch(r"\s*([A-Za-z]\w*)\s*", rest):
                        inner, _, _ = body(("endset",), False)
                        add(("capture", m[1], inner))
                        continue
                    m = re.fullmatch(r"\s*([A-Za-z]\w*)(?:\.([A-Za-z]\w*))?\s*=(?!=)\s*(.+)", rest, re.S)
                    if not m:
                        raise TemplateError(f"can't read set {rest}")
                    add(("set", m[1], m[2], _Expression(m[3]).whole()))
                elif word == "generation":
                    inner, _, _ = body(("endgeneration",), looped)
                    add(("generation", inner))
                elif word in ("break", "continue") and looped:
                    add((word,))
                else:
                    raise TemplateError(f"unknown tag {word!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return out, "", ""

    return body((), False)[0]


class _Out:
    __slots__ = ("parts", "size", "spans")

    def __init__(self):
        self.parts, self.size, self.spans = [], 0, []

    def add(self, s: str) -> None:
        self.parts.append(s)
        self.size += len(s)
        if self.size > LONGEST:
            raise TemplateError("a text grows too long")


def _statements(nodes: list) -> Callable[[dict, _Out], str | None]:
    """A function that runs the steps; it gives "break" or "continue" if one of them says so."""
    steps = [_statement(n) for n in nodes]
    if len(steps) == 1:
        return steps[0]

    def run(env, out):
        for s in steps:
            if said := s(env, out):
                return said
        return None

    return run


def _statement(node) -> Callable[[dict, _Out], str | None]:
    kind = node[0]
    if kind == "text":
        text = node[1]
        return lambda env, out: out.add(text)
    if kind == "out":
        f = _closure(node[1])
        return lambda env, out: out.add(text_of(f(env)))
    if kind in ("break", "continue"):
        return lambda env, out: kind
    if kind == "set":
        name, key, f = node[1], node[2], _closure(node[3])

        def assign(env, out):
            env[name] = f(env)

        def assign_in(env, out):
            if not isinstance(env.get(name), _Space):
                raise TemplateError(f"{name} isn't a namespace")
            env[name].values[key] = f(env)

        return assign_in if key else assign
    if kind == "capture":
        name, inner = node[1], _statements(node[2])

        def capture(env, out):
            part = _Out()
            inner(env, part)
            env[name] = "".join(part.parts)

        return capture
    if kind == "if":
        arms = [(_closure(t), _statements(b)) for t, b in node[1]]

        def choose(env, out):
            for test, inner in arms:
                if test(env):
                    return inner(env, out)
            return None

        return choose
    if kind == "generation":
        inner = _statements(node[1])

        def mark(env, out):
            start = out.size
            said = inner(env, out)
            if out.size > start:
                out.spans.append((start, out.size))
            return said

        return mark
    names, f, test, inner, none = node[1], _closure(node[2]), None if node[3] is None else _closure(node[3]), _statements(node[4]), _statements(node[5])

    def bind(env, row):
        if len(names) == 1:
            env[names[0]] = row
        elif isinstance(row, list) and len(row) == len(names):
            env.update(zip(names, row))
        else:
            raise TemplateError(f"a row isn't {len(names)} values")

    def loop(env, out):
        rows = f(env)
        rows = list(rows) if isinstance(rows, dict) else rows if isinstance(rows, list) else []
        if test is not None:
            kept = []
            for row in rows:
                own = dict(env)
                bind(own, row)
                if test(own):
                    kept.append(row)
            rows = kept
        n = len(rows)
        if not n:
            return none(env, out)
        for i, row in enumerate(rows):
            own = dict(env)
            bind(own, row)
            own["loop"] = {"index": i + 1, "index0": i, "revindex": n - i, "revindex0": n - i - 1, "first": i == 0, "last": i == n - 1, "length": n} | ({"previtem": rows[i - 1]} if i else {}) | ({"nextitem": rows[i + 1]} if i + 1 < n else {})
            if inner(own, out) == "break":
                break
        return None

    return loop


def compile_template(source: str, blocks: bool = False) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """A function from variables to (text, [(start, end) of each generated stretch])."""
    run = _statements(parse(source, blocks))

    def render(variables: dict) -> tuple[str, list[tuple[int, int]]]:
        out = _Out()
        run(dict(variables), out)
        return "".join(out.parts), out.spans

    return render


def render_chats(rows: DataFrame, template: str = CHATML, variables: dict | None = None, blocks: bool = False) -> DataFrame:
    """(conv_id, n_messages INT, rendered STRING, generated STRING): one row for each conversation of (conv_id, turn, role, text).

    generated lists the character ranges "start-end" of the generation marks, joined by commas. A message's text is also known as its content.
    """
    compile_template(template, blocks)  # errors show before any job
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    flat = chats.select("conv_id", F.transform("m", lambda x: F.struct(F.coalesce(x["role"], F.lit("")).alias("role"), F.coalesce(x["text"], F.lit("")).alias("text"), x["turn"].alias("turn"))).alias("m"))
    schema = T.StructType([rows.schema["conv_id"], T.StructField("n_messages", T.IntegerType()), T.StructField("rendered", T.StringType()), T.StructField("generated", T.StringType())])

    def run(batches):
        render = compile_template(template, blocks)
        for b in batches:
            n, text, spans = [], [], []
            for messages in b.column(1).to_pylist():
                n.append(len(messages))
                for m in messages:
                    m["content"] = m["text"]
                try:
                    t, s = render({**(variables or {}), "messages": messages})
                except TemplateError:
                    text.append(None)
                    spans.append(None)
                    continue
                text.append(t)
                spans.append(",".join(f"{x}-{y}" for x, y in s))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), pa.array(text, pa.string()), pa.array(spans, pa.string())], names=["conv_id", "n_messages", "rendered", "generated"])

    return flat.mapInArrow(run, schema)


def op8_chat_format(spark, sf_dir: str) -> DataFrame:
    """Every conversation in ChatML with the ranges that the assistant generated."""
    return render_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = {
    "op8_chat_format": """
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as body from conversations),
p as (select *, '<|im_start|>' || role || chr(10) || body || '<|im_end|>' || chr(10) as piece from t),
o as (select *, coalesce(sum(length(piece)) over (partition by conv_id order by turn, role, body rows between unbounded preceding and 1 preceding), 0) as before from p)
select conv_id, count(*)::int as n_messages, string_agg(piece, '' order by turn, role, body) as rendered,
 coalesce(string_agg(case when role = 'assistant' then (before + length('<|im_start|>' || role) + 1)::bigint::varchar || '-' || (before + length(piece) - 1)::bigint::varchar end, ',' order by turn, role, body), '') as generated
from o group by conv_id"""
}
