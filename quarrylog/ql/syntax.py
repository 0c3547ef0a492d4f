"""Lexer, syntax tree and parser of the object-oriented language, shared with plain Datalog."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


class SyntaxFault(ValueError):
    """A text that does not parse; the message has line and column."""


KEYWORDS = set("""and or not exists forall forex if then else instanceof any none from where select as import module class extends
abstract predicate this result super true false in override private deprecated""".split())
AGGREGATES = {"count", "strictcount", "min", "max", "sum", "strictsum", "avg", "concat", "strictconcat", "unique", "rank"}
_TOKEN = re.compile(
    r"(?P<space>\s+|//[^\n]*|/\*.*?\*/)|(?P<end>\.(?=\s|$))|(?P<real>\d+\.\d+)|(?P<int>\d+)|(?P<string>\"(?:\\.|[^\"\\])*\")"
    r"|(?P<name>[A-Za-z]\w*|_\w+)|(?P<entity>@\w+)|(?P<op>:-|::|!=|<=|>=|[_=<>+*/%(){}\[\],;:|.?-])",
    re.DOTALL,
)


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int


def tokens(text: str, datalog: bool = False) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SyntaxFault(f"{place(text, at)}: unexpected {text[at]!r}")
        kind = m.lastgroup
        if kind == "end" and not datalog:
            kind = "op"
        if kind == "name" and m[0] in KEYWORDS:
            kind = "word"
        if kind != "space":
            out.append(Token(kind, m[0], at))
        at = m.end()
    return [*out, Token("eof", "", at)]


def place(text: str, at: int) -> str:
    line = text.count("\n", 0, at) + 1
    return f"line {line}, column {at - text.rfind(chr(10), 0, at)}"


# ---- expressions


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Lit:
    value: int | float | str


@dataclass(frozen=True)
class Blank:
    pass


@dataclass(frozen=True)
class Bin:
    op: str
    left: object
    right: object | None


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    closure: str = ""
    named: tuple = ()  # names of args, where given


@dataclass(frozen=True)
class Method:
    receiver: object  # None: super
    name: str
    args: tuple
    closure: str = ""


@dataclass(frozen=True)
class Cast:
    value: object
    type: str


@dataclass(frozen=True)
class Decl:
    type: str | None
    name: str


@dataclass(frozen=True)
class AggExpr:
    func: str
    separator: str | None
    decls: tuple[Decl, ...]
    body: object | None
    value: object | None


# ---- formulas


@dataclass(frozen=True)
class AllOf:
    parts: tuple


@dataclass(frozen=True)
class AnyOf:
    parts: tuple


@dataclass(frozen=True)
class Negated:
    part: object


@dataclass(frozen=True)
class Compare:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Holds:
    call: object


@dataclass(frozen=True)
class Quantified:
    kind: str  # exists, forall, forex
    decls: tuple[Decl, ...]
    guard: object | None
    body: object | None


@dataclass(frozen=True)
class Conditional:
    test: object
    then: object
    other: object


@dataclass(frozen=True)
class InstanceOf:
    value: object
    type: str


@dataclass(frozen=True)
class Constant:
    value: bool


# ---- declarations


@dataclass
class Predicate:
    name: str
    params: tuple[Decl, ...]
    result: str | None  # type
    body: object | None
    override: bool = False
    private: bool = False


@dataclass
class Class:
    name: str
    supers: tuple[str, ...]
    abstract: bool
    character: object | None = None
    members: list[Predicate] = field(default_factory=list)


@dataclass
class Module:
    name: str = ""
    imports: list[tuple[str, str | None]] = field(default_factory=list)
    classes: list[Class] = field(default_factory=list)
    predicates: list[Predicate] = field(default_factory=list)
    modules: list[Module] = field(default_factory=list)
    select: tuple | None = None  # (decls, where, ((expression, label), ...))


class Parser:
    def __init__(self, text: str, datalog: bool = False):
        self.text, self.datalog = text, datalog
        self.toks, self.i = tokens(text, datalog), 0

    # -- helpers

    @property
    def tok(self) -> Token:
        return self.toks[self.i]

    def fail(self, wanted: str):
        found = repr(self.tok.text) if self.tok.text else "the end"
        raise SyntaxFault(f"{place(self.text, self.tok.at)}: expected {wanted}, found {found}")

    def peek(self, *texts: str) -> bool:
        return self.tok.text in texts and self.tok.kind != "string"

    def accept(self, *texts: str) -> str | None:
        if self.peek(*texts):
            self.i += 1
            return self.toks[self.i - 1].text
        return None

    def expect(self, text: str) -> None:
        if not self.accept(text):
            self.fail(repr(text))

    def name(self) -> str:
        if self.tok.kind != "name":
            self.fail("a name")
        self.i += 1
        return self.toks[self.i - 1].text

    def qualified(self) -> str:
        if self.tok.kind == "entity":
            self.i += 1
            return self.toks[self.i - 1].text
        out = self.name()
        while self.accept("::"):
            out += "::" + self.name()
        return out

    # -- formulas

    def formula(self):
        parts = [self.conjunction()]
        while self.accept("or", ";") if self.datalog else self.accept("or"):
            parts.append(self.conjunction())
        return parts[0] if len(parts) == 1 else AnyOf(tuple(parts))

    def conjunction(self):
        parts = [self.unary()]
        while self.accept("and", ",") if self.datalog else self.accept("and"):
            parts.append(self.unary())
        return parts[0] if len(parts) == 1 else AllOf(tuple(parts))

    def unary(self):
        if self.accept("not"):
            return Negated(self.unary())
        if self.accept("if"):
            test = self.formula()
            self.expect("then")
            then = self.unary()
            self.expect("else")
            return Conditional(test, then, self.unary())
        if self.peek("exists", "forall", "forex"):
            return self.quantified()
        if self.peek("any", "none") and self.toks[self.i + 1].text == "(" and self.toks[self.i + 2].text == ")":
            kind = self.accept("any", "none")
            self.i += 2
            return Constant(kind == "any")
        if self.peek("("):
            mark = self.i
            try:
                self.i += 1
                inner = self.formula()
                self.expect(")")
                if self.tok.kind == "end" or not self.peek("=", "!=", "<", ">", "<=", ">=", "+", "-", "*", "/", "%", ".", "instanceof"):
                    return inner
            except SyntaxFault:
                pass
            self.i = mark
        return self.comparison()

    def quantified(self):
        kind = self.accept("exists", "forall", "forex")
        self.expect("(")
        decls = self.decls()
        parts = []
        while self.accept("|"):
            parts.append(self.formula())
        self.expect(")")
        if kind == "exists":
            return Quantified(kind, decls, parts[0] if len(parts) == 2 else None, parts[-1] if parts else None)
        if not parts or len(parts) > 2:
            self.fail("a range and a condition")
        return Quantified(kind, decls, parts[0] if len(parts) == 2 else None, parts[-1])

    def decls(self) -> tuple[Decl, ...]:
        out = []
        while True:
            first = self.qualified()
            if self.tok.kind == "name":
                out.append(Decl(first, self.name()))
            elif self.datalog:
                out.append(Decl(None, first))
            else:
                self.fail("a variable")
            if not self.accept(","):
                return tuple(out)

    def comparison(self):
        left = self.expression()
        if op := self.accept("=", "!=", "<", ">", "<=", ">="):
            return Compare(op, left, self.expression())
        if self.accept("instanceof"):
            return InstanceOf(left, self.qualified())
        if isinstance(left, (Call, Method)):
            return Holds(left)
        if isinstance(left, Lit) and isinstance(left.value, bool):
            return Constant(left.value)
        self.fail("a comparison")

    # -- expressions

    def expression(self):
        left = self.product()
        while op := self.accept("+", "-"):
            left = Bin(op, left, self.product())
        return left

    def product(self):
        left = self.sign()
        while op := self.accept("*", "/", "%"):
            left = Bin(op, left, self.sign())
        return left

    def sign(self):
        if self.accept("-"):
            return Bin("neg", self.sign(), None)
        return self.postfix()

    def postfix(self):
        value = self.primary()
        while self.tok.kind == "op" and self.peek("."):
            self.i += 1
            if self.accept("("):
                value = Cast(value, self.qualified())
                self.expect(")")
                continue
            name = self.name()
            closure = self.closure()
            args = self.args()[0] if self.peek("(") else ()
            value = Method(value, name, args, closure)
        return value

    def closure(self) -> str:
        if self.peek("+", "*") and self.toks[self.i + 1].text == "(":
            return self.accept("+", "*")
        return ""

    def args(self) -> tuple[tuple, tuple]:
        self.expect("(")
        args, names = [], []
        if not self.peek(")"):
            while True:
                if self.datalog and self.tok.kind == "name" and self.toks[self.i + 1].text == ":":
                    names.append(self.name())
                    self.i += 1
                args.append(self.expression())
                if not self.accept(","):
                    break
        self.expect(")")
        if names and len(names) != len(args):
            self.fail("a name for each argument")
        return tuple(args), tuple(names)

    def primary(self):
        t = self.tok
        if t.kind == "int" or t.kind == "real":
            self.i += 1
            return Lit(int(t.text) if t.kind == "int" else float(t.text))
        if t.kind == "string":
            self.i += 1
            return Lit(unescape(t.text))
        if self.accept("("):
            value = self.expression()
            self.expect(")")
            return value
        if self.accept("_"):
            return Blank()
        if word := self.accept("true", "false"):
            return Lit(word == "true")
        if word := self.accept("this", "result"):
            return Name(word)
        if self.accept("super"):
            self.expect(".")
            name = self.name()
            return Method(None, name, self.args()[0])
        if t.kind in ("name", "entity"):
            if t.text in AGGREGATES and self.toks[self.i + 1].text == "(":
                return self.aggregate()
            name = self.qualified()
            closure = self.closure()
            if self.peek("("):
                args, names = self.args()
                return Call(name, args, closure, names)
            return Name(name)
        self.fail("an expression")

    def aggregate(self):
        func = self.name()
        self.expect("(")
        separator = None
        if self.tok.kind == "string" and self.toks[self.i + 1].text == "|":
            separator = unescape(self.tok.text)
            self.i += 2
        decls = self.decls()
        body = self.formula() if self.accept("|") and not self.peek("|") else None
        value = self.expression() if self.accept("|") else None
        if value is not None and self.accept(",") and self.tok.kind == "string":
            separator = unescape(self.tok.text)
            self.i += 1
        self.expect(")")
        return AggExpr(func, separator, decls, body, value)

    # -- declarations

    def module(self, nested: bool = False) -> Module:
        out = Module()
        while self.tok.kind != "eof" and not (nested and self.peek("}")):
            flags = self.flags()
            if self.accept("import"):
                path = self.path()
                out.imports.append((path, self.name() if self.accept("as") else None))
            elif self.accept("module"):
                name = self.name()
                self.expect("{")
                inner = self.module(True)
                self.expect("}")
                inner.name = name
                out.modules.append(inner)
            elif self.accept("class"):
                out.classes.append(self.class_body("abstract" in flags))
            elif self.peek("from", "select") and not nested:
                out.select = self.selection()
            else:
                out.predicates.append(self.predicate(flags))
        return out

    def flags(self) -> set[str]:
        out = set()
        while True:
            if word := self.accept("abstract", "override", "private", "deprecated"):
                out.add(word)
            elif self.tok.kind == "name" and self.tok.text in ("pragma", "bindingset", "language", "cached", "query", "final", "external", "transient", "library") and (self.toks[self.i + 1].text == "[" or self.tok.text in ("cached", "query", "final")):
                self.i += 1
                if self.accept("["):
                    while not self.accept("]"):
                        self.i += 1
            else:
                return out

    def path(self) -> str:
        out = self.name()
        while self.accept(".", "::"):
            out += "." + self.name()
        return out

    def class_body(self, abstract: bool) -> Class:
        name, supers = self.name(), []
        if self.accept("extends"):
            while True:
                supers.append(self.qualified())
                if not self.accept(","):
                    break
        out = Class(name, tuple(supers), abstract)
        self.expect("{")
        while not self.accept("}"):
            flags = self.flags()
            if self.tok.text == name and self.toks[self.i + 1].text == "(":
                self.i += 2
                self.expect(")")
                self.expect("{")
                out.character = self.formula()
                self.expect("}")
            else:
                out.members.append(self.predicate(flags))
        return out

    def predicate(self, flags: set[str]) -> Predicate:
        result = None if self.accept("predicate") else self.qualified()
        name = self.name()
        self.expect("(")
        params = () if self.peek(")") else self.decls()
        self.expect(")")
        body = None
        if self.accept("{"):
            body = self.formula() if not self.peek("}") else Constant(True)
            self.expect("}")
        else:
            self.expect(";")
        return Predicate(name, params, result, body, "override" in flags, "private" in flags)

    def selection(self) -> tuple:
        decls = self.decls() if self.accept("from") else ()
        where = self.formula() if self.accept("where") else None
        self.expect("select")
        items = []
        while True:
            value = self.expression()
            label = None
            if self.accept("as"):
                label = unescape(self.tok.text) if self.tok.kind == "string" else self.tok.text
                self.i += 1
            items.append((value, label))
            if not self.accept(","):
                return decls, where, tuple(items)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}.get(m[1], m[1]), text[1:-1], flags=re.DOTALL)


def parse_module(text: str) -> Module:
    return Parser(text).module()
