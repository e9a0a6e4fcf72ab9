"""Declarations and expression nodes of a C# file by recursive descent; what can't be read is skipped and noted.

The parser knows no types. Every expression that may refer to a symbol becomes a node that names the node its
receiver comes from, so that all files' nodes can be resolved together by joins (plans.references).
"""

from __future__ import annotations

import re
from typing import Any

from .lexer import Source, Token, string_value

KINDS = {"class": "class", "struct": "struct", "interface": "interface", "enum": "enum", "record": "record"}
MODIFIERS = frozenset("public private protected internal static abstract sealed virtual override const readonly partial extern unsafe async new volatile required file ref fixed".split())
PREDEFINED = frozenset("bool byte sbyte char decimal double float int uint long ulong short ushort object string void nint nuint dynamic".split())
_STATEMENTS = frozenset("if else while for foreach do switch case default return throw try catch finally using lock fixed goto break continue yield checked unchecked unsafe".split())
_NO_TYPE = _STATEMENTS | frozenset("new this base typeof sizeof nameof await stackalloc is as in out true false null delegate namespace class struct interface enum event operator where".split()) - {"default"}
_ASSIGN = frozenset("= += -= *= /= %= &= |= ^= ??= <<=".split())
_BINARY = frozenset("+ - * / % & | ^ && || == != < > <= >= << ?? ..".split())
_VISIBLE = "public protected internal private".split()
_PASSING = frozenset("ref in out params this scoped readonly".split())
UNKNOWN = -1
ERROR_CHARS = 200


class Stop(Exception):
    """The parser can't go on here."""


def _squeeze(text: str) -> str:
    return re.sub(r"\s+", "", text)


class Parser:
    def __init__(self, code: str):
        self.source = Source(code)
        self.tokens, self.pos = self.source.tokens, 0
        self.out: dict[str, list[dict[str, Any]]] = {k: [] for k in "types methods fields properties strings inheritance nodes".split()}
        self.usings: list[str] = []
        self.errors: list[str] = list(self.source.errors)
        self.namespace, self.types = "", []
        self.method: int | None = None
        self.scope: dict[str, int] = {}

    # tokens

    def peek(self, k: int = 0) -> str:
        try:
            return self.tokens[self.pos + k].text
        except IndexError:
            return ""

    def kind(self, k: int = 0) -> str:
        try:
            return self.tokens[self.pos + k].kind
        except IndexError:
            return ""

    def take(self) -> Token:
        if self.pos >= len(self.tokens):
            raise Stop("end of file")
        self.pos += 1
        return self.tokens[self.pos - 1]

    def accept(self, text: str) -> bool:
        tokens, pos = self.tokens, self.pos
        if pos < len(tokens) and tokens[pos].text == text:
            self.pos = pos + 1
            return True
        return False

    def expect(self, text: str) -> None:
        if not self.accept(text):
            raise Stop(self.peek() or "end of file")

    def name(self) -> str:
        if self.kind() != "id":
            raise Stop(self.peek() or "end of file")
        return self.take().text.lstrip("@")

    def line(self, at: int | None = None) -> int:
        at = self.pos if at is None else at
        return self.source.line(self.tokens[min(at, len(self.tokens) - 1)].start) if self.tokens else 1

    def text(self, start: int, end: int) -> str:
        return self.source.code[self.tokens[start].start : self.tokens[end - 1].end] if end > start else ""

    def fail(self, what: str) -> None:
        self.errors.append((what.strip() or "ERROR")[:ERROR_CHARS])

    def skip_balanced(self, closer: str) -> None:
        """Go behind the closer of a bracket that was just opened; strings on the way are kept."""
        opener, level = {"}": "{", ")": "(", "]": "["}[closer], 1
        while level:
            t = self.take()
            if t.kind in ("str", "verb", "inter", "raw"):
                self.string(t)
            level += (t.text == opener) - (t.text == closer)

    # records

    def string(self, t: Token) -> None:
        value = string_value(t)
        if value is not None:
            self.out["strings"].append({"type": self.types[-1]["ordinal"] if self.types else None, "method": self.method, "value": value, "line": self.source.line(t.start)})
        for a, b in t.holes:
            self.hole(a, b)

    def hole(self, a: int, b: int) -> None:
        held = self.tokens, self.pos
        self.tokens, self.pos = self.source.scan(a, b), 0
        try:
            if self.tokens:
                self.expression()
        except Stop:
            pass
        self.tokens, self.pos = held

    def node(self, op: str, name: str, recv: int = UNKNOWN, kind: str = "", argc: int = 0, start: int = 0, end: int = 0, hint: str | None = None) -> int:
        a = self.tokens[min(start, len(self.tokens) - 1)]
        b = self.tokens[min(max(end - 1, start), len(self.tokens) - 1)]
        nodes, lines, last = self.out["nodes"], self.source.lines, b.end - 1
        first, final = self.source.line(a.start), self.source.line(last)
        nodes.append({
            "node": len(nodes), "op": op, "name": name, "recv": recv, "level": nodes[recv]["level"] + 1 if recv >= 0 else 0, "kind": kind, "argc": argc, "hint": hint[:80] if hint else None,
            "namespace": self.namespace, "type": self.types[-1]["ordinal"] if self.types else None, "method": self.method,
            "line": first, "column": a.start - lines[first - 1], "end_line": final, "end_column": last - lines[final - 1] + 1,
        })
        return len(nodes) - 1

    # types in the grammar's sense

    def skip_type(self) -> None:
        """Go behind a type or raise Stop."""
        while self.peek() in ("ref", "readonly", "scoped"):
            self.pos += 1
        if self.accept("("):
            while True:
                self.skip_type()
                if self.kind() == "id":
                    self.pos += 1
                if not self.accept(","):
                    break
            self.expect(")")
        else:
            while True:
                if self.kind() != "id" or (self.peek() in _NO_TYPE):
                    raise Stop(self.peek())
                self.pos += 1
                if self.peek() == "<":
                    self.skip_type_arguments()
                if self.peek() in (".", "::") and self.kind(1) == "id":
                    self.pos += 1
                    continue
                break
        while True:
            if self.peek() == "[" and self.peek(1) in ("]", ","):
                self.pos += 1
                while self.accept(","):
                    pass
                self.expect("]")
            elif self.peek() in ("?", "*"):
                self.pos += 1
            else:
                return

    def skip_type_arguments(self) -> None:
        self.expect("<")
        while self.peek() in (",", ">") or self.skip_one_argument():
            if self.accept(","):
                continue
            break
        self.expect(">")

    def skip_one_argument(self) -> bool:
        while self.peek() in ("in", "out"):
            self.pos += 1
        if self.peek() == "[":
            self.pos += 1
            self.skip_balanced("]")
        self.skip_type()
        return True

    def type_ref(self, start: int, kind: str, keep: str = "type") -> int:
        """A node for the type from start to here, and for its generic arguments; UNKNOWN for predefined ones."""
        end = self.pos
        if end == start + 1 and self.tokens[start].text in PREDEFINED:
            return UNKNOWN
        text = self.text(start, end)
        head = _squeeze(text).rstrip("?*")
        head = re.sub(r"(\[,*\])+$", "", head)
        found = self.node(keep, _squeeze(text), kind=kind, start=start, end=end) if head not in PREDEFINED and not text.startswith("(") else UNKNOWN
        for k in range(start, end):
            if self.tokens[k].kind == "id" and self.tokens[k].text not in PREDEFINED and k > start and self.tokens[k - 1].text in ("<", ",") and (k + 1 >= end or self.tokens[k + 1].text != "<"):
                stop = k + 1
                while stop + 1 < end and self.tokens[stop].text == "." and self.tokens[stop + 1].kind == "id":
                    stop += 2
                self.node("type_if_known", _squeeze(self.text(k, stop)), kind="generic_argument", start=k, end=stop)
        return found

    def try_type(self) -> bool:
        at = self.pos
        try:
            self.skip_type()
            return True
        except Stop:
            self.pos = at
            return False

    # file

    def parse(self) -> dict[str, Any]:
        self.namespace = self.file_namespace()
        while self.pos < len(self.tokens):
            at = self.pos
            try:
                self.top_level()
            except Stop as e:
                self.recover(at, str(e))
        out = self.out
        out["parse_error"] = self.errors[0] if self.errors else None
        out["parse_status"] = "OK" if not self.errors else "PARTIAL" if out["types"] else "FAILED"
        out["usings"] = self.usings
        return out

    def recover(self, at: int, what: str) -> None:
        self.fail(what)
        self.pos = max(self.pos, at + 1)
        while self.pos < len(self.tokens) and self.peek() not in ("}", ";") and self.peek() not in KINDS and self.peek() not in ("namespace", "public", "private", "protected", "internal"):
            self.pos += 1
        if self.peek() == ";":
            self.pos += 1

    def file_namespace(self) -> str:
        depth = 0
        for k, t in enumerate(self.tokens):
            depth += (t.text == "{") - (t.text == "}")
            if t.text == "namespace" and depth == 0:
                end = k + 1
                while end < len(self.tokens) and (self.tokens[end].kind == "id" or self.tokens[end].text == "."):
                    end += 1
                if end < len(self.tokens) and self.tokens[end].text == ";":
                    return _squeeze(self.text(k + 1, end))
        return ""

    def dotted(self) -> str:
        parts = [self.name()]
        while self.peek() in (".", "::") and self.kind(1) == "id":
            self.pos += 1
            parts.append(self.name())
        return ".".join(parts)

    def top_level(self) -> None:
        if self.peek() == "global" and self.peek(1) == "using":
            self.pos += 1
        if self.peek() == "using" and self.peek(1) != "(":
            self.pos += 1
            self.accept("static")
            self.accept("unsafe")
            name = self.dotted()
            self.usings.append(name)
            while self.peek() not in (";", ""):
                self.pos += 1
            self.expect(";")
        elif self.peek() == "extern" and self.peek(1) == "alias":
            self.pos += 3
            self.expect(";")
        elif self.accept("namespace"):
            name, held = self.dotted(), self.namespace
            if self.accept(";"):
                return
            self.namespace = f"{held}.{name}" if held else name
            self.expect("{")
            while not self.accept("}"):
                if self.pos >= len(self.tokens):
                    self.namespace = held
                    raise Stop("end of file")
                at = self.pos
                try:
                    self.top_level()
                except Stop as e:
                    self.recover(at, str(e))
            self.namespace = held
        elif self.peek() in ("}", ";"):
            if self.take().text == "}":
                self.fail("}")
        else:
            self.attributes()
            start, modifiers = self.pos, self.modifiers()
            if not self.type_declaration(start, modifiers):
                raise Stop(self.peek() or "end of file")

    def attributes(self) -> None:
        while self.peek() == "[":
            self.pos += 1
            if self.kind() == "id" and self.peek(1) == ":":
                self.pos += 2
            while not self.accept("]"):
                start = self.pos
                self.dotted()
                if self.peek() == "<":
                    self.skip_type_arguments()
                self.node("type_if_known", _squeeze(self.text(start, self.pos)), kind="attribute", start=start, end=self.pos)
                if self.accept("("):
                    self.skip_balanced(")")
                self.accept(",")

    def modifiers(self) -> set[str]:
        found = set()
        while self.peek() in MODIFIERS and not (self.peek() in ("file", "required") and self.kind(1) != "id") and not (self.peek() == "ref" and self.peek(1) != "struct"):
            found.add(self.take().text)
        return found

    @staticmethod
    def visibility(modifiers: set[str]) -> str:
        return next(filter(modifiers.__contains__, _VISIBLE), "internal")

    @staticmethod
    def flags(modifiers: set[str], *words: str) -> dict[str, int]:
        return {"is_" + w: int(w in modifiers) for w in words}

    def type_declaration(self, start: int, modifiers: set[str]) -> bool:
        word = self.peek()
        if word == "delegate" and self.peek(1) not in ("(", "{"):
            self.pos += 1
            self.skip_type()
            name, generated = self.type_name()
            record = self.begin_type(start, modifiers, "delegate", name, generated)
            if self.peek() == "<":
                self.skip_type_arguments()
            self.expect("(")
            self.skip_balanced(")")
            self.constraints()
            self.expect(";")
            self.end_type(record)
            return True
        if word not in KINDS or (word == "record" and self.kind(1) != "id"):
            return False
        self.pos += 1
        if word == "record":
            if not self.accept("struct"):
                self.accept("class")
        name, generated = self.type_name()
        record = self.begin_type(start, modifiers, KINDS[word], name, generated)
        try:
            if self.peek() == "<":
                self.skip_type_arguments()
            if self.accept("("):
                self.skip_balanced(")")
            if self.accept(":"):
                self.base_list(record)
            self.constraints()
            if self.accept("{"):
                if word == "enum":
                    self.skip_balanced("}")
                else:
                    self.members(record)
                self.accept(";")
            else:
                self.expect(";")
        finally:
            self.end_type(record)
        return True

    def type_name(self) -> tuple[str, bool]:
        generated = False
        if self.peek() == "<":
            generated = True
            self.fail(self.peek() + self.peek(1))
            while self.take().text != ">":
                pass
        return self.name(), generated

    def begin_type(self, start: int, modifiers: set[str], kind: str, name: str, generated: bool) -> dict:
        parent = self.types[-1] if self.types else None
        outer = parent["full_name"] if parent else self.namespace
        record = {
            "ordinal": len(self.out["types"]), "parent": parent["ordinal"] if parent else None, "namespace": self.namespace, "name": name, "full_name": f"{outer}.{name}" if outer else name, "kind": kind,
            "visibility": self.visibility(modifiers), **self.flags(modifiers, "abstract", "static", "sealed"), "is_compiler_generated": int(generated), "start_line": self.line(start), "end_line": self.line(start),
        }
        self.out["types"].append(record)
        self.types.append(record)
        return record

    def end_type(self, record: dict) -> None:
        record["end_line"] = self.line(self.pos - 1)
        self.types.pop()
        self.method, self.scope = None, {}

    def base_list(self, record: dict) -> None:
        first = True
        while True:
            start = self.pos
            self.skip_type()
            relation = "base" if first else "interface"
            self.out["inheritance"].append({"type": record["ordinal"], "relation": relation, "target_name": _squeeze(self.text(start, self.pos))})
            self.type_ref(start, "inherit" if first else "interface")
            if self.accept("("):
                self.skip_balanced(")")
            first = False
            if not self.accept(","):
                return

    def constraints(self) -> None:
        while self.peek() == "where":
            while self.peek() not in ("{", ";", "=>", ""):
                self.pos += 1
                if self.peek() == "where":
                    break

    # members

    def members(self, record: dict) -> None:
        while not self.accept("}"):
            if self.pos >= len(self.tokens):
                raise Stop("end of file")
            at = self.pos
            self.method, self.scope = None, {}
            try:
                self.member(record)
            except Stop as e:
                self.fail(str(e))
                self.pos = max(self.pos, at + 1)
                self.resync()
        self.method, self.scope = None, {}

    def resync(self) -> None:
        """Go to the end of the broken member: behind its semicolon or block, or before the type's closing brace."""
        if self.pos and self.tokens[self.pos - 1].text == ";":
            return
        while self.pos < len(self.tokens) and self.peek() != "}":
            t = self.take().text
            if t == ";":
                return
            if t == "{":
                try:
                    self.skip_balanced("}")
                except Stop:
                    pass
                return

    def member(self, record: dict) -> None:
        if self.accept(";"):
            return
        self.attributes()
        start, modifiers = self.pos, self.modifiers()
        if self.type_declaration(start, modifiers):
            return
        if self.accept("event"):
            self.skip_type()
            self.dotted()
            if self.accept("="):
                self.expression()
            if not self.accept(";"):
                self.accessors()
            return
        if self.accept("~"):
            self.method_rest(start, modifiers, self.name(), None, None)
            return
        if self.peek() in ("implicit", "explicit"):
            self.pos += 1
            self.operator_rest()
            return
        if self.kind() == "id" and self.peek(1) == "(" and self.peek() not in PREDEFINED:
            self.pos += 1
            self.method_rest(start, modifiers, ".cctor" if "static" in modifiers else ".ctor", None, None)
            return
        type_start = self.pos
        self.skip_type()
        type_end = self.pos
        if self.peek() == "operator":
            self.operator_rest()
            return
        if self.peek() == "this" or (self.kind() == "id" and self.explicit_this()):
            self.property_rest(start, modifiers, "this[]", type_start, type_end)
            return
        name = self.name()
        while True:
            if self.peek() == "<":
                self.skip_type_arguments()
            if self.accept("."):
                name = self.name() if self.peek() != "this" else "this[]"
                continue
            break
        if self.peek() == "(":
            self.method_rest(start, modifiers, name, type_start, type_end)
        elif self.peek() in ("{", "=>"):
            self.property_rest(start, modifiers, name, type_start, type_end)
        else:
            self.fields_rest(modifiers, name, type_start, type_end)

    def explicit_this(self) -> bool:
        k = 0
        while self.kind(k) == "id" and self.peek(k + 1) == ".":
            k += 2
        if k and self.peek(k) == "this":
            self.pos += k
            return True
        return False

    def operator_rest(self) -> None:
        while self.peek() != "(" or self.peek(1) == ")" and self.peek(2) == "(":
            self.take()
        self.expect("(")
        self.parameters()
        self.body()

    def parameters(self, closer: str = ")") -> list[str]:
        """Types of the parameters; their names enter the scope."""
        found = []
        while not self.accept(closer):
            self.attributes()
            while self.peek() in _PASSING:
                self.pos += 1
            start = self.pos
            self.skip_type()
            found.append(_squeeze(self.text(start, self.pos)))
            at = self.type_ref(start, "parameter_type")
            if self.kind() == "id":
                self.scope[self.name()] = at
            if self.accept("="):
                self.expression()
            if self.peek() not in (",", closer):
                raise Stop(self.peek() or "end of file")
            self.accept(",")
        return found

    def method_rest(self, start: int, modifiers: set[str], name: str, type_start: int | None, type_end: int | None) -> None:
        record = {
            "ordinal": len(self.out["methods"]), "type": self.types[-1]["ordinal"], "name": name, "signature": "", "return_type": None if type_start is None else " ".join(self.text(type_start, type_end).split()),
            "visibility": self.visibility(modifiers), **self.flags(modifiers, "static", "virtual", "override", "abstract"),
            "start_line": self.line(start), "end_line": self.line(start),
        }
        self.out["methods"].append(record)
        self.method = record["ordinal"]
        if type_start is not None:
            here, self.pos = self.pos, type_end
            self.type_ref(type_start, "return_type")
            self.pos = here
        self.expect("(")
        record["signature"] = f"{name}({','.join(self.parameters())})"
        self.constraints()
        if self.accept(":"):
            self.take()
            self.expect("(")
            self.arguments()
        self.body()
        record["end_line"] = self.line(self.pos - 1)
        self.method, self.scope = None, {}

    def body(self) -> None:
        if self.accept("=>"):
            self.expression()
            self.expect(";")
        elif self.accept("{"):
            self.block()
        else:
            self.expect(";")

    def property_rest(self, start: int, modifiers: set[str], name: str, type_start: int, type_end: int) -> None:
        here, self.pos = self.pos, type_end
        self.type_ref(type_start, "property_type")
        self.pos = here
        if name == "this[]":
            self.accept("this")
            self.expect("[")
            self.parameters("]")
        if self.accept("=>"):
            getter, setter = 1, 0
            self.expression()
            self.expect(";")
        else:
            getter, setter = self.accessors()
            if self.accept("="):
                self.expression()
                self.expect(";")
        self.out["properties"].append({
            "type": self.types[-1]["ordinal"], "name": name, "property_type": _squeeze(self.text(type_start, type_end)), "visibility": self.visibility(modifiers), "has_getter": getter, "has_setter": setter,
            **self.flags(modifiers, "static"), "start_line": self.line(start), "end_line": self.line(self.pos - 1),
        })

    def accessors(self) -> tuple[int, int]:
        getter = setter = 0
        self.expect("{")
        while not self.accept("}"):
            self.attributes()
            self.modifiers()
            word = self.name()
            getter |= word in ("get", "add")
            setter |= word in ("set", "init", "remove")
            held = dict(self.scope)
            if word != "get":
                self.scope["value"] = UNKNOWN
            self.body()
            self.scope = held
        return int(getter), int(setter)

    def fields_rest(self, modifiers: set[str], name: str, type_start: int, type_end: int) -> None:
        here, self.pos = self.pos, type_end
        self.type_ref(type_start, "field_type")
        self.pos = here
        while True:
            self.out["fields"].append({
                "type": self.types[-1]["ordinal"], "name": name, "field_type": _squeeze(self.text(type_start, type_end)), "visibility": self.visibility(modifiers),
                **self.flags(modifiers, "static", "readonly", "const"), "start_line": self.line(self.pos - 1),
            })
            if self.peek() == "[":
                self.pos += 1
                self.skip_balanced("]")
            if self.accept("="):
                self.expression()
            if self.accept(","):
                name = self.name()
                continue
            self.expect(";")
            return

    # statements

    def block(self) -> None:
        while not self.accept("}"):
            if self.pos >= len(self.tokens):
                raise Stop("end of file")
            at = self.pos
            try:
                self.statement()
            except Stop as e:
                if self.pos >= len(self.tokens):
                    raise
                self.fail(str(e))
                self.pos = max(self.pos, at + 1)
                while self.pos < len(self.tokens) and self.peek() not in (";", "}", "{"):
                    self.pos += 1
                self.accept(";")

    def statement(self) -> None:
        word = self.peek()
        if self.accept(";"):
            return
        if self.accept("{"):
            self.block()
            return
        self.attributes() if word == "[" else None
        if word in ("if", "while", "switch", "lock") or (word in ("using", "fixed") and self.peek(1) == "("):
            self.pos += 1
            self.expect("(")
            if word not in ("using", "fixed") or not self.local_declaration(")"):
                self.expression()
            self.expect(")")
            self.statement()
        elif word == "foreach" or (word == "await" and self.peek(1) == "foreach"):
            self.pos += 1 + (word == "await")
            self.foreach()
        elif word == "for":
            self.pos += 1
            self.expect("(")
            if not self.accept(";"):
                if not self.local_declaration(";"):
                    self.expressions()
                self.expect(";")
            if not self.accept(";"):
                self.expression()
                self.expect(";")
            if self.peek() != ")":
                self.expressions()
            self.expect(")")
            self.statement()
        elif word == "do":
            self.pos += 1
            self.statement()
            self.expect("while")
            self.expect("(")
            self.expression()
            self.expect(")")
            self.expect(";")
        elif word == "catch":
            self.pos += 1
            if self.accept("("):
                start = self.pos
                self.skip_type()
                at = self.type_ref(start, "type_use")
                if self.kind() == "id":
                    self.scope[self.name()] = at
                self.expect(")")
            if self.peek() == "when":
                self.pos += 1
                self.expect("(")
                self.expression()
                self.expect(")")
            self.statement()
        elif word == "case" or (word == "default" and self.peek(1) == ":"):
            self.pos += 1
            if word == "case":
                self.pattern()
                if self.accept("when"):
                    self.expression()
            self.expect(":")
        elif word in ("else", "try", "finally") or (word in ("checked", "unchecked", "unsafe") and self.peek(1) == "{"):
            self.pos += 1
            self.statement()
        elif word in ("return", "throw") or (word == "yield" and self.peek(1) in ("return", "break")):
            self.pos += 1 + (word == "yield")
            if self.peek() != ";":
                self.expression()
            self.expect(";")
        elif word in ("break", "continue", "goto"):
            while self.take().text != ";":
                pass
        elif word in ("using", "await") and self.local_using():
            self.expect(";")
        elif self.local_function() or (self.local_declaration(";") and (self.expect(";") or True)):
            return
        elif self.kind() == "id" and self.peek(1) == ":" and self.peek(2) != ":":
            self.pos += 2
        else:
            self.expression()
            self.expect(";")

    def local_using(self) -> bool:
        at = self.pos
        self.accept("await")
        if self.accept("using") and self.local_declaration(";"):
            return True
        self.pos = at
        return False

    def foreach(self) -> None:
        self.expect("(")
        if self.peek() == "var":
            self.pos += 1
            at = UNKNOWN
            if self.accept("("):
                self.skip_balanced(")")
                name = None
            else:
                name = self.name()
        else:
            start = self.pos
            self.skip_type()
            at = self.type_ref(start, "type_use")
            name = self.name()
        if name:
            self.scope[name] = at
        self.expect("in")
        self.expression()
        self.expect(")")
        self.statement()

    def local_function(self) -> bool:
        at = self.pos
        while self.peek() in ("static", "async", "unsafe", "extern"):
            self.pos += 1
        if not self.try_type() or self.kind() != "id" or self.peek() in _NO_TYPE:
            self.pos = at
            return False
        self.pos += 1
        try:
            if self.peek() == "<":
                self.skip_type_arguments()
        except Stop:
            self.pos = at
            return False
        if self.peek() != "(" or not self.opens_body():
            self.pos = at
            return False
        self.pos += 1
        self.parameters()
        self.constraints()
        self.body()
        return True

    def opens_body(self) -> bool:
        """Whether the bracket here closes before a block, an arrow or a constraint."""
        k = self.matching(self.pos)
        return k is not None and k + 1 < len(self.tokens) and self.tokens[k + 1].text in ("{", "=>", "where")

    def matching(self, at: int) -> int | None:
        level = 0
        for k in range(at, len(self.tokens)):
            t = self.tokens[k].text
            level += (t in ("(", "[", "{")) - (t in (")", "]", "}"))
            if level == 0:
                return k
        return None

    def local_declaration(self, closer: str) -> bool:
        at = self.pos
        self.accept("const")
        self.accept("ref")
        start = self.pos
        if self.peek() in _STATEMENTS or not self.try_type():
            self.pos = at
            return False
        end = self.pos
        if self.kind() != "id" or self.peek(1) not in ("=", ";", ",", closer) or self.peek() in _NO_TYPE:
            self.pos = at
            return False
        inferred = self.text(start, end) == "var"
        declared = UNKNOWN if inferred else self.type_ref(start, "type_use")
        while True:
            name, value = self.name(), UNKNOWN
            if self.accept("="):
                self.accept("ref")
                value = self.expression()
            self.scope[name] = value if inferred else declared
            if not self.accept(","):
                return True

    # expressions: each gives the node that its static type comes from

    def expressions(self) -> None:
        self.expression()
        while self.accept(","):
            self.expression()

    def arguments(self, closer: str = ")") -> int:
        """Arguments up to the closer, which is taken; how many."""
        n = 0
        while not self.accept(closer):
            if self.kind() == "id" and self.peek(1) == ":" and self.peek(2) != ":":
                self.pos += 2
            if self.peek() in ("ref", "out", "in"):
                out = self.take().text == "out"
                at = self.pos
                if out and (self.peek() == "var" or self.try_type()) and (self.pos > at or self.peek() == "var"):
                    if self.peek() == "var":
                        self.pos += 1
                    if self.kind() == "id" and self.peek(1) in (",", closer):
                        end = self.pos
                        known = UNKNOWN if self.text(at, end) == "var" else self.type_ref(at, "type_use")
                        self.scope[self.name()] = known
                    else:
                        self.pos = at
                        self.expression()
                else:
                    self.pos = at
                    self.expression()
            else:
                self.expression()
            n += 1
            if self.peek() not in (",", closer):
                raise Stop(self.peek() or "end of file")
            self.accept(",")
        return n

    def is_lambda(self) -> bool:
        at = self.pos
        if self.peek() in ("async", "static") and (self.kind(1) == "id" or self.peek(1) == "("):
            at += 1
        if at >= len(self.tokens):
            return False
        if self.tokens[at].text == "(":
            end = self.matching(at)
            return end is not None and end + 1 < len(self.tokens) and self.tokens[end + 1].text == "=>"
        return self.tokens[at].kind == "id" and at + 1 < len(self.tokens) and self.tokens[at + 1].text == "=>"

    def lambda_rest(self) -> int:
        while self.peek() in ("async", "static") and self.peek(1) != "=>":
            self.pos += 1
        held = dict(self.scope)
        if self.accept("("):
            while not self.accept(")"):
                at = self.pos
                while self.peek() in ("ref", "in", "out"):
                    self.pos += 1
                if self.kind() == "id" and self.peek(1) in (",", ")"):
                    self.scope[self.name()] = UNKNOWN
                else:
                    start = self.pos
                    self.skip_type()
                    known = self.type_ref(start, "parameter_type")
                    self.scope[self.name()] = known
                self.accept(",")
                if self.pos == at:
                    raise Stop(self.peek())
        else:
            self.scope[self.name()] = UNKNOWN
        self.expect("=>")
        if self.accept("{"):
            self.block()
        else:
            self.expression()
        self.scope = held
        return UNKNOWN

    def expression(self) -> int:
        if self.is_lambda():
            return self.lambda_rest()
        start, first = self.pos, len(self.out["nodes"])
        left = self.conditional()
        if self.peek() in _ASSIGN or (self.peek() == ">" and self.peek(1) == ">="):
            op = self.take().text
            if op == ">":
                self.take()
            self.mark(left, first, "write" if op == "=" else "read_write", start)
            self.expression()
            return UNKNOWN
        return left

    def mark(self, node: int, first: int, mode: str, start: int) -> None:
        """The outermost member or name of an assigned expression is written."""
        nodes = self.out["nodes"]
        if node >= first and nodes[node]["op"] in ("member", "ident"):
            nodes[node]["kind"] = mode

    def conditional(self) -> int:
        left = self.binary()
        if self.peek() == "?":
            self.pos += 1
            self.expression()
            self.expect(":")
            self.expression()
            return UNKNOWN
        return left

    def binary(self) -> int:
        left = self.unary()
        while True:
            op = self.peek()
            if op in ("is", "as"):
                self.pos += 1
                if op == "is":
                    self.pattern()
                    left = UNKNOWN
                else:
                    start = self.pos
                    self.skip_type_in_expression()
                    left = self.type_ref(start, "as")
            elif op in ("switch", "with") and self.peek(1) == "{":
                self.pos += 1
                self.switch_arms() if op == "switch" else self.initializer()
                left = UNKNOWN if op == "switch" else left
            elif op in _BINARY:
                self.pos += 1
                if op == ">" and self.peek() == ">":
                    self.pos += 1
                if op == ".." and self.peek() in ("]", ")", ","):
                    return UNKNOWN
                if self.is_lambda():
                    self.lambda_rest()
                elif self.accept("throw"):
                    self.expression()
                else:
                    self.unary()
                left = left if op == "??" else UNKNOWN
            else:
                return left

    def skip_type_in_expression(self) -> None:
        """A type after as or is: a ? that begins a conditional isn't part of it."""
        self.skip_type()
        if self.tokens[self.pos - 1].text == "?" and (self.kind() in ("id", "num", "str", "char", "verb", "inter") or self.peek() in ("(", "-", "!")):
            self.pos -= 1

    def pattern(self) -> None:
        while self.accept("not"):
            pass
        if self.accept("_"):
            pass
        elif self.accept("("):
            self.pattern_list(")")
        elif self.peek() == "{":
            self.property_pattern()
        elif self.accept("["):
            self.pattern_list("]")
        elif self.peek() in ("<", ">", "<=", ">=", "==", "!="):
            self.pos += 1
            self.unary()
        elif self.accept("var"):
            self.accept("(") and self.skip_balanced(")")
            if self.kind() == "id":
                self.scope[self.name()] = UNKNOWN
        elif self.peek() in ("null", "true", "false", "default", "..") or self.kind() in ("num", "str", "char", "verb", "inter", "raw") or self.peek() in ("-", "typeof", "nameof"):
            self.accept("..") or self.unary()
        else:
            start = self.pos
            self.skip_type_in_expression()
            known = self.type_ref(start, "type_use", "type_if_known")
            if self.accept("("):
                self.pattern_list(")")
            if self.peek() == "{":
                self.property_pattern()
            if self.kind() == "id" and self.peek() not in ("and", "or", "when", "is", "as", "switch", "with"):
                self.scope[self.name()] = known
        while self.peek() in ("and", "or"):
            self.pos += 1
            self.pattern()

    def pattern_list(self, closer: str) -> None:
        while not self.accept(closer):
            if self.kind() == "id" and self.peek(1) == ":":
                self.pos += 2
            self.pattern()
            if self.peek() not in (",", closer):
                raise Stop(self.peek())
            self.accept(",")

    def property_pattern(self) -> None:
        self.expect("{")
        while not self.accept("}"):
            self.dotted()
            self.expect(":")
            self.pattern()
            if self.peek() not in (",", "}"):
                raise Stop(self.peek())
            self.accept(",")
        if self.kind() == "id" and self.peek() not in ("and", "or", "when"):
            self.scope[self.name()] = UNKNOWN

    def switch_arms(self) -> None:
        self.expect("{")
        while not self.accept("}"):
            self.pattern()
            if self.accept("when"):
                self.expression()
            self.expect("=>")
            if self.accept("throw"):
                pass
            self.expression()
            if self.peek() not in (",", "}"):
                raise Stop(self.peek())
            self.accept(",")

    def unary(self) -> int:
        op, first, start = self.peek(), len(self.out["nodes"]), self.pos
        if op in ("++", "--"):
            self.pos += 1
            self.mark(self.unary(), first, "read_write", start)
            return UNKNOWN
        if op in ("+", "-", "!", "~", "&", "*", "^"):
            self.pos += 1
            self.unary()
            return UNKNOWN
        if op in ("await", "throw"):
            self.pos += 1
            return self.unary() if op == "await" else self.expression()
        if op == ".." and self.peek(1) not in ("]", ")"):
            self.pos += 1
            return self.unary()
        if op == "(" and self.is_cast():
            self.pos += 1
            begin = self.pos
            self.skip_type()
            end = self.pos
            self.expect(")")
            self.unary()
            here, self.pos = self.pos, end
            found = self.type_ref(begin, "cast")
            self.pos = here
            return found
        return self.postfix(first, start)

    def is_cast(self) -> bool:
        at = self.pos
        self.pos += 1
        begin = self.pos
        try:
            self.skip_type()
            if self.peek() != ")":
                return False
            simple = self.pos == begin + 1 and self.tokens[begin].text in PREDEFINED
            self.pos += 1
            after, kind = self.peek(), self.kind()
            if kind in ("num", "str", "char", "verb", "inter", "raw") or after in ("(", "!", "~"):
                return True
            if kind == "id" and after not in ("is", "as", "switch", "with", "and", "or", "in"):
                return True
            return simple and after in ("+", "-", "++", "--", "*", "&")
        except Stop:
            return False
        finally:
            self.pos = at

    def postfix(self, first: int, start: int) -> int:
        left = self.primary()
        while True:
            op = self.peek()
            if op in (".", "?.", "->", "::") and self.kind(1) == "id":
                self.pos += 1
                hint = self.text(start, self.pos - 1)
                name = self.name()
                self.generic_call()
                if self.accept("("):
                    n = self.arguments()
                    left = self.node("call", name, recv=left, argc=n, start=start, end=self.pos, hint=hint)
                else:
                    left = self.node("member", name, recv=left, kind="read", start=start, end=self.pos)
            elif op == "[" or (op == "?" and self.peek(1) == "[" and self.indexed()):
                self.pos += 1 + (op == "?")
                self.arguments("]")
                left = UNKNOWN
            elif op == "(":
                self.pos += 1
                self.arguments()
                left = UNKNOWN
            elif op in ("++", "--"):
                self.pos += 1
                self.mark(left, first, "read_write", start)
                left = UNKNOWN
            elif op == "!" and self.peek(1) in (".", ")", ";", ",", "[", "?."):
                self.pos += 1
            else:
                return left

    def indexed(self) -> bool:
        """Whether ?[ here is a null-conditional index and not a conditional with a collection."""
        end = self.matching(self.pos + 1)
        return end is not None and end + 1 < len(self.tokens) and self.tokens[end + 1].text != ":"

    def generic_call(self) -> bool:
        """Take type arguments here if they are such."""
        if self.peek() != "<":
            return False
        at = self.pos
        try:
            self.skip_type_arguments()
            if self.peek() in ("(", ")", "]", "}", ":", ";", ",", ".", "?", "==", "!=", "?.", ""):
                end, self.pos = self.pos, at
                for k in range(at + 1, end - 1):
                    if self.tokens[k].kind == "id" and self.tokens[k].text not in PREDEFINED and self.tokens[k - 1].text in ("<", ","):
                        stop = k + 1
                        while self.tokens[stop].text == "." and stop + 1 < end:
                            stop += 2
                        self.node("type_if_known", _squeeze(self.text(k, stop)), kind="generic_argument", start=k, end=stop)
                self.pos = end
                return True
        except Stop:
            pass
        self.pos = at
        return False

    def initializer(self) -> None:
        """An object or collection initializer."""
        self.expect("{")
        while not self.accept("}"):
            if self.accept("["):
                self.arguments("]")
                self.expect("=")
            elif self.kind() == "id" and self.peek(1) == "=":
                self.pos += 2
            if self.peek() == "{":
                self.initializer()
            else:
                self.expression()
            if self.peek() not in (",", "}"):
                raise Stop(self.peek() or "end of file")
            self.accept(",")

    def creation(self) -> int:
        start = self.pos - 1
        if self.accept("("):
            self.arguments()
            if self.peek() == "{":
                self.initializer()
            return UNKNOWN
        if self.peek() == "{":
            self.initializer()
            return UNKNOWN
        if self.peek() == "[":
            self.pos += 1
            self.skip_balanced("]")
            if self.peek() == "{":
                self.initializer()
            return UNKNOWN
        begin = self.pos
        while True:
            self.name()
            if self.peek() == "<":
                self.skip_type_arguments()
            if not (self.peek() in (".", "::") and self.kind(1) == "id"):
                break
            self.pos += 1
        self.accept("?") if self.peek(1) in ("[", "(") else None
        kind = self.type_ref(begin, "instantiate")
        text = self.text(begin, self.pos)
        n = 0
        if self.peek() == "[":
            while self.peek() == "[":
                self.pos += 1
                self.arguments("]") if self.peek() not in (",", "]") else self.skip_balanced("]")
            if self.peek() == "{":
                self.initializer()
            return UNKNOWN
        if self.accept("("):
            n = self.arguments()
        if kind != UNKNOWN:
            self.node("ctor", ".ctor", recv=kind, argc=n, start=start, end=self.pos, hint=text)
        if self.peek() == "{":
            self.initializer()
        return kind

    def primary(self) -> int:
        t = self.take()
        word, start = t.text, self.pos - 1
        if t.kind in ("str", "verb", "inter", "raw"):
            self.string(t)
            return UNKNOWN
        if t.kind in ("num", "char") or word in ("true", "false", "null"):
            return UNKNOWN
        if word == "(":
            inner = self.expression()
            n = 1
            while self.accept(","):
                n += 1
                self.expression()
            if self.kind() == "id" and self.peek(1) in (",", ")"):
                self.pos += 1
            self.expect(")")
            return (inner if n == 1 else UNKNOWN)
        if word == "[":
            self.arguments("]")
            return UNKNOWN
        if word == "this":
            return self.node("this", "this", start=start, end=self.pos)
        if word == "base":
            return self.node("base", "base", start=start, end=self.pos)
        if word == "new":
            return self.creation()
        if word in ("typeof", "sizeof", "default", "nameof", "checked", "unchecked") and self.peek() == "(":
            self.pos += 1
            if word in ("typeof", "sizeof"):
                begin = self.pos
                self.skip_type()
                self.type_ref(begin, "typeof")
                self.expect(")")
                return self.node("external", "System.Type", start=start, end=self.pos)
            if word == "default" and self.try_type() and self.accept(")"):
                return UNKNOWN
            inner = self.expression()
            self.expect(")")
            return (inner if word in ("checked", "unchecked") else UNKNOWN)
        if word == "default":
            return UNKNOWN
        if word == "delegate":
            held = dict(self.scope)
            if self.accept("("):
                self.parameters()
            self.expect("{")
            self.block()
            self.scope = held
            return UNKNOWN
        if word == "stackalloc":
            return self.creation()
        if t.kind != "id" or (word in _NO_TYPE and word not in ("in", "out")):
            raise Stop(word)
        name = word.lstrip("@")
        if name in PREDEFINED:
            return self.node("external", name, start=start, end=self.pos)
        self.generic_call()
        if self.peek() == "(":
            self.pos += 1
            n = self.arguments()
            if name in self.scope:
                return UNKNOWN
            return self.node("call", name, recv=-2, argc=n, start=start, end=self.pos)
        if name in self.scope:
            return self.scope[name]
        return self.node("ident", name, kind="read", start=start, end=self.pos)


def parse_source(content: bytes) -> dict[str, Any]:
    """Declarations, literals and nodes of one file; never raises."""
    parser = Parser(content.decode("utf-8-sig", "replace"))
    try:
        return parser.parse()
    except RecursionError:
        parser.fail("nested too deeply")
        out = parser.out
        return out | {"parse_error": parser.errors[0], "parse_status": "PARTIAL" if out["types"] else "FAILED", "usings": parser.usings}
