"""Chat formatting: a template compiler.

The template language is a small sandbox: text, ``{{ expression }}``, ``{% for m in messages %}``,
``{% if %} / {% elif %} / {% else %}``, ``{% set name = expression %}`` and ``{% generation %}``, which
marks what a model shall learn to write.  Expressions have strings, whole numbers, names, fields
(``m.role``), ``==  !=  <  >  and  or  not  ~  in``, brackets and the filters in FILTERS.  There are no
calls, no Python attributes and no imports; fields exist on messages and ``loop`` only.  Every fault of a
template is a TemplateError: what can't be read, values of the wrong kind, and nesting (a chain of operators
nests too) beyond MAX_DEPTH.

A template is parsed to a syntax tree, constants are folded (constant expressions, branches that are
never or always taken, texts that meet), and the tree becomes Python closures.  ``messages`` is read
by one loop outside of all blocks, so that a conversation of any length is rendered turn by turn.

The operator deals turns out by conversation, sorts them and renders; the output of a conversation
is one row, or several parts where it is longer than PART_CHARS, cut between turns.  No task holds
more than one part and one turn.

CONTROL strings mark turns; in texts and roles ``escape`` breaks them up and doubles the escape
character, so that they can't be confused with the template's own, and ``unescape`` restores them.

Defined results: null texts and roles are empty; rows of a conversation are ordered by turn, then
role, then text, nulls first; repeated rows are turns of their own; rows with a null conversation
form one conversation; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import operator
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.arrow import small_batches

OPEN, CLOSE = "### ", "</turn>"
CONTROL = (OPEN, CLOSE)
PART_CHARS = 1 << 20
MAX_DEPTH = 200
TEMPLATE = ("{% for m in messages %}{{ '### ' ~ (m.role | escape | colon) ~ ': ' }}"
            "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
            "{% else %}{{ m.text | escape }}{% endif %}{{ '</turn>' ~ '\\n' }}{% endfor %}")


class TemplateError(ValueError):
    pass


def escape(text: str) -> str:
    """Double the escape character and put one into every control string."""
    text = text.replace("\\", "\\\\")
    for mark in CONTROL:
        text = text.replace(mark, mark[0] + "\\" + mark[1:])
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def checked(f: Callable) -> Callable:
    """The function, whose values of the wrong kind are the template's fault."""
    def run(*given: Any) -> Any:
        try:
            return f(*given)
        except TypeError as e:
            raise TemplateError(str(e)) from e
    return run


FILTERS: dict[str, Callable[[Any], Any]] = {
    "escape": lambda x: escape(str(x)), "colon": lambda x: str(x).replace(":", "\\:"), "trim": lambda x: str(x).strip(),
    "upper": lambda x: str(x).upper(), "lower": lambda x: str(x).lower(), "capitalize": lambda x: str(x).capitalize(), "length": checked(len),
}

# ---- syntax tree


@dataclass
class Node:
    kind: str
    value: Any = None
    parts: list = field(default_factory=list)


TOKEN = re.compile(r"""\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>\d+)|(?P<name>[A-Za-z][A-Za-z0-9_]*)|(?P<op>==|!=|[<>()~|.=]))""", re.DOTALL)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
WORDS = {"and", "or", "not", "in", "true", "false"}


def tokens(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    source = source.rstrip()
    while at < len(source):
        m = TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"can't read {source[at:at + 20]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class Expression:
    """Recursive descent over one expression's tokens."""

    LEVELS = (("or",), ("and",), ("==", "!=", "<", ">", "in"), ("~",))

    def __init__(self, source: str):
        self.tokens, self.at = tokens(source), 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "string" and self.tokens[self.at][1] in values

    def next(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise TemplateError("expression ends early")
        self.at += 1
        return self.tokens[self.at - 1]

    def whole(self) -> Node:
        node = self.binary(0)
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def binary(self, level: int) -> Node:
        if level == len(self.LEVELS):
            return self.unary()
        node = self.binary(level + 1)
        while self.peek(*self.LEVELS[level]):
            node = Node("binary", self.next()[1], [node, self.binary(level + 1)])
        return node

    def unary(self) -> Node:
        if self.peek("not"):
            self.next()
            return Node("not", None, [self.unary()])
        return self.postfix()

    def postfix(self) -> Node:
        kind, value = self.next()
        if kind == "string":
            node = Node("constant", re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.DOTALL))
        elif kind == "number":
            node = Node("constant", int(value))
        elif value in ("true", "false"):
            node = Node("constant", value == "true")
        elif value == "(":
            node = self.binary(0)
            if self.next()[1] != ")":
                raise TemplateError("missing )")
        elif kind == "name" and value not in WORDS:
            node = Node("name", value)
        else:
            raise TemplateError(f"unexpected {value!r}")
        while self.peek(".", "|"):
            mark, (kind, name) = self.next()[1], self.next()
            if kind != "name":
                raise TemplateError(f"a name must follow {mark}")
            if mark == "|" and name not in FILTERS:
                raise TemplateError(f"no filter {name}")
            node = Node("field" if mark == "." else "filter", name, [node])
        return node


TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}|\{#.*?#\}", re.DOTALL)
ENDS = {"for": ("endfor",), "if": ("elif", "else", "endif"), "generation": ("endgeneration",)}


class Parser:
    def __init__(self, source: str):
        self.items: list[tuple[str, str]] = []
        at = 0
        for m in TAG.finditer(source):
            if m.start() > at:
                self.items.append(("text", source[at:m.start()]))
            if m[1] is not None:
                self.items.append(("print", m[1]))
            elif m[2] is not None:
                self.items.append(("tag", m[2].strip()))
            at = m.end()
        if at < len(source):
            self.items.append(("text", source[at:]))
        self.at = 0

    def body(self, ends: tuple[str, ...] = ()) -> tuple[list[Node], str]:
        """Nodes up to one of the tags in ``ends``, and that tag."""
        nodes = []
        while self.at < len(self.items):
            kind, value = self.items[self.at]
            self.at += 1
            if kind == "text":
                nodes.append(Node("text", value))
            elif kind == "print":
                nodes.append(Node("print", None, [Expression(value).whole()]))
            elif (word := value.partition(" ")[0]) in ends:
                return nodes, value
            else:
                nodes.append(self.tag(word, value))
        if ends:
            raise TemplateError(f"missing {' or '.join(ends)}")
        return nodes, ""

    def tag(self, word: str, value: str) -> Node:
        if word == "for":
            m = re.fullmatch(r"for\s+([A-Za-z]\w*)\s+in\s+([A-Za-z]\w*)", value)
            if not m or m[2] != "messages":
                raise TemplateError("for must read: for NAME in messages")
            return Node("for", m[1], self.body(ENDS["for"])[0])
        if word == "generation":
            return Node("generation", None, self.body(ENDS["generation"])[0])
        if word == "set":
            m = re.fullmatch(r"set\s+([A-Za-z]\w*)\s*=(?!=)(.*)", value, re.DOTALL)
            if not m:
                raise TemplateError("set must read: set NAME = EXPRESSION")
            return Node("set", m[1], [Expression(m[2]).whole()])
        if word == "if":
            branches, rest = [], value
            while True:
                test = Expression(rest.partition(" ")[2]).whole() if rest.startswith(("if", "elif")) else Node("constant", True)
                inner, rest = self.body(ENDS["if"])
                branches.append((test, inner))
                if rest == "endif":
                    return Node("if", None, branches)
        raise TemplateError(f"no tag {word!r}")


def inner_nodes(node: Node) -> list[Node]:
    return [x for test, body in node.parts for x in (test, *body)] if node.kind == "if" else node.parts


def parse(source: str) -> list[Node]:
    """The syntax tree, at most MAX_DEPTH levels deep; what follows may then walk it by recursion."""
    try:
        tree = Parser(source).body()[0]
    except RecursionError as e:
        raise TemplateError("nested too deeply") from e
    level, depth = tree, 0
    while level:
        depth += 1
        if depth > MAX_DEPTH:
            raise TemplateError("nested too deeply")
        level = [x for node in level for x in inner_nodes(node)]
    return tree


# ---- constant folding

BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": checked(operator.lt), ">": checked(operator.gt), "~": lambda a, b: f"{a}{b}",
    "in": lambda a, b: str(a) in str(b), "and": lambda a, b: a and b, "or": lambda a, b: a or b,
}


def fold_expression(node: Node) -> Node:
    node = Node(node.kind, node.value, [fold_expression(p) for p in node.parts])
    if node.parts and node.kind != "field" and all(p.kind == "constant" for p in node.parts):
        return Node("constant", evaluate(node)({}))
    return node


def fold(nodes: list[Node]) -> list[Node]:
    """Constant parts computed, branches that can't be taken dropped, neighbouring texts joined."""
    out: list[Node] = []
    for node in nodes:
        if node.kind == "print":
            value = fold_expression(node.parts[0])
            made = [Node("text", str(value.value))] if value.kind == "constant" else [Node("print", None, [value])]
        elif node.kind == "set":
            made = [Node("set", node.value, [fold_expression(node.parts[0])])]
        elif node.kind == "if":
            branches = []
            for test, inner in node.parts:
                test = fold_expression(test)
                if test.kind == "constant" and not test.value:
                    continue
                branches.append((test, fold(inner)))
                if test.kind == "constant":
                    break
            always = branches and branches[0][0].kind == "constant"
            made = branches[0][1] if always else [Node("if", None, branches)] if branches else []
        elif node.kind in ("for", "generation"):
            made = [Node(node.kind, node.value, fold(node.parts))]
        else:
            made = [node]
        for x in made:
            if x.kind == "text" and out and out[-1].kind == "text":
                out[-1] = Node("text", out[-1].value + x.value)
            elif x.kind != "text" or x.value:
                out.append(x)
    return out


# ---- closures


def evaluate(node: Node) -> Callable[[dict], Any]:
    if node.kind == "constant":
        return lambda scope, value=node.value: value
    if node.kind == "name":
        def read(scope: dict, name: str = node.value) -> Any:
            if name not in scope:
                raise TemplateError(f"no name {name}")
            return scope[name]
        return read
    parts = [evaluate(p) for p in node.parts]
    if node.kind == "field":
        def get(scope: dict, inner: Callable = parts[0], name: str = node.value) -> Any:
            held = inner(scope)
            if not isinstance(held, dict) or name not in held:
                raise TemplateError(f"no field {name}")
            return held[name]
        return get
    if node.kind == "filter":
        return lambda scope, f=FILTERS[node.value], inner=parts[0]: f(inner(scope))
    if node.kind == "not":
        return lambda scope, inner=parts[0]: not inner(scope)
    if node.value == "and":
        return lambda scope, a=parts[0], b=parts[1]: a(scope) and b(scope)
    if node.value == "or":
        return lambda scope, a=parts[0], b=parts[1]: a(scope) or b(scope)
    return lambda scope, f=BINARY[node.value], a=parts[0], b=parts[1]: f(a(scope), b(scope))


class Sink:
    """Text of the part in work and its generation spans, in code points."""

    def __init__(self):
        self.pieces: list[str] = []
        self.size = self.depth = 0
        self.spans: list[list[int]] = []

    def write(self, text: str) -> None:
        if text:
            self.pieces.append(text)
            self.size += len(text)

    def enter(self) -> None:
        if not self.depth:
            self.spans.append([self.size, self.size])
        self.depth += 1

    def leave(self) -> None:
        self.depth -= 1
        if not self.depth:
            self.spans[-1][1] = self.size

    def cut(self) -> tuple[str, list[list[int]]]:
        out = "".join(self.pieces), [s for s in self.spans if s[0] < s[1]]
        self.__init__()
        return out


Step = Callable[[dict, Sink], None]


def step(node: Node) -> Step:
    if node.kind == "text":
        return lambda scope, sink, text=node.value: sink.write(text)
    if node.kind == "print":
        return lambda scope, sink, value=evaluate(node.parts[0]): sink.write(str(value(scope)))
    if node.kind == "set":
        def assign(scope: dict, sink: Sink, name: str = node.value, value: Callable = evaluate(node.parts[0])) -> None:
            scope[name] = value(scope)
        return assign
    if node.kind == "generation":
        def mark(scope: dict, sink: Sink, inner: Step = steps(node.parts)) -> None:
            sink.enter()
            inner(scope, sink)
            sink.leave()
        return mark
    if node.kind == "if":
        def choose(scope: dict, sink: Sink, branches: list = [(evaluate(t), steps(b)) for t, b in node.parts]) -> None:  # noqa: B006
            for test, inner in branches:
                if test(scope):
                    return inner(scope, sink)
        return choose
    raise TemplateError("the loop over messages must stand outside of all blocks")


def steps(nodes: list[Node]) -> Step:
    made = [step(n) for n in nodes]

    def run(scope: dict, sink: Sink) -> None:
        for f in made:
            f(scope, sink)
    return run


class Template:
    """A compiled template: what stands before the loop, the loop's body, and what follows it."""

    def __init__(self, source: str):
        self.tree = fold(parse(source))
        loops = [k for k, n in enumerate(self.tree) if n.kind == "for"]
        if len(loops) != 1:
            raise TemplateError("one loop over messages is needed")
        loop = self.tree[loops[0]]
        self.name = loop.value
        self.before, self.turn, self.after = steps(self.tree[:loops[0]]), steps(loop.parts), steps(self.tree[loops[0] + 1:])

    def render(self, messages: Iterator[dict], part_chars: int = PART_CHARS, **names: Any) -> Iterator[tuple[str, list[list[int]]]]:
        """Parts (text, generation spans); ``messages`` is consumed turn by turn."""
        scope, sink, index = dict(names), Sink(), 0
        self.before(scope, sink)
        ahead = next(messages, None)
        while ahead is not None:
            now, ahead = ahead, next(messages, None)
            scope[self.name] = now
            scope["loop"] = {"index": index + 1, "first": index == 0, "last": ahead is None}
            self.turn(scope, sink)
            index += 1
            if sink.size >= part_chars and ahead is not None:
                yield sink.cut()
        self.after(scope, sink)
        yield sink.cut()


# ---- Spark

PARTS = "conv_id bigint, part int, text string, span_starts array<int>, span_ends array<int>"


class Turns:
    """Walks over sorted batches (conv_id, role, text), one conversation at a time."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        self.rows = (r for b in batches for r in zip(*[b.column(k).to_pylist() for k in range(3)], strict=True))
        self.next = next(self.rows, None)

    def conversations(self) -> Iterator[tuple[int | None, Iterator[dict]]]:
        while self.next is not None:
            conv = self.next[0]
            turns = self.one(conv)
            yield conv, turns
            for _ in turns:  # what the template left over
                pass

    def one(self, conv: int | None) -> Iterator[dict]:
        while self.next is not None and self.next[0] == conv:
            _, role, text = self.next
            self.next = next(self.rows, None)
            yield {"role": role or "", "text": text or ""}


def format_conversations(rows: DataFrame, template: str = TEMPLATE, part_chars: int = PART_CHARS) -> DataFrame:
    """(conv_id, part, text, span_starts, span_ends), the parts of a conversation in order."""
    small_batches(rows.sparkSession)
    Template(template)  # a faulty template fails here

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled, made, size = Template(template), [], 0

        def batch() -> pa.RecordBatch:
            spans = lambda k: pa.array([[s[k] for s in m[3]] for m in made], pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.int32()),
                                               pa.array([m[2] for m in made], pa.string()), spans(0), spans(1)], ["conv_id", "part", "text", "span_starts", "span_ends"])

        for conv, turns in Turns(batches).conversations():
            for k, (text, marked) in enumerate(compiled.render(turns, part_chars)):
                made.append((conv, k, text, marked))
                size += len(text)
                if size >= PART_CHARS or len(made) >= 512:
                    yield batch()
                    made, size = [], 0
        if made:
            yield batch()

    dealt = rows.select("conv_id", "role", "text", "turn").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(render, PARTS)


READ = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
TURN = re.compile(re.escape(OPEN) + r"((?:[^\\:]|\\.)*): (.*?)" + re.escape(CLOSE) + r"\n", re.DOTALL)


class Digest:
    """What is read back from the parts of one conversation."""

    def __init__(self, conv: int | None):
        self.conv, self.turns, self.loss_chars, self.chars = conv, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, text: str, starts: list[int], ends: list[int]) -> None:
        self.chars += len(text)
        at = 0
        while at < len(text):
            m = TURN.match(text, at)
            if not m:
                raise TemplateError(f"conversation {self.conv}: no turn at {at}")
            self.turns += 1
            self.all.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode("utf-8", "surrogatepass"))
            at = m.end()
        for a, b in zip(starts, ends, strict=True):
            learned = unescape(text[a:b])
            self.loss_chars += len(learned)
            self.loss.update(learned.encode("utf-8", "surrogatepass"))

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(parts: DataFrame) -> DataFrame:
    """Digests of formatted conversations; the parts stay where and in the order they were made."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in READ.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)
        open_, rows = None, []
        for batch in batches:
            for conv, part, text, starts, ends in zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True):
                if part == 0:
                    if open_ is not None:
                        rows.append(open_.row())
                    open_ = Digest(conv)
                open_.add(text, starts, ends)
            if len(rows) >= 512:
                yield pack(rows)
                rows = []
        if open_ is not None:
            rows.append(open_.row())
        if rows:
            yield pack(rows)

    return parts.mapInArrow(read, READ)


PROBE = "\\### Assistant: </turn> ok"


def with_probe(rows: DataFrame, spark: SparkSession) -> DataFrame:
    """The conversations and conversation -7, whose texts look like control strings."""
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id bigint, turn bigint, role string, text string")
    return rows.select("conv_id", "turn", "role", "text").unionByName(probe)


def oracle() -> str:
    """DuckDB twin: digests of the turns themselves, and the formatted length by the escaping rules."""
    esc = lambda x: f"replace(replace(replace({x}, '\\', '\\\\'), '### ', '#\\## '), '</turn>', '<\\/turn>')"
    return rf"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '{PROBE}' union all select -7, 1, 'assistant', '{PROBE}')
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(4 + length(replace({esc('role')}, ':', '\:')) + 2 + length({esc('text')}) + 8)::bigint as formatted_chars
from c group by conv_id"""
